"""Suffix dedup by hashes of anchored chunks and of whole windows.

The contract asks for byte strings that repeat, as a suffix array would find them.  This operator gets
them by hashing, not by merging Burrows-Wheeler transforms; the merge by interleave refinement is in
``interleave.py``, which tests hold this operator to (README has its cost).

Each text is sampled at content-defined anchors (the leftmost minimal 8-byte hash of a sliding
window), so equal texts are sampled alike.  Every window of ``min_bytes`` belongs to exactly one anchor,
and equal windows to anchors at the same offset with the same R bytes behind them.

1. Anchors meet by the hash of their first R bytes (sorted within a bucket); a hash with one anchor is done.
2. Anchors that meet are told apart by the hash of the widest context that their windows reach.  Where
   it is equal, each window that belongs to the anchor repeats.
3. Where it is not, each start of a window sends the hash of its ``min_bytes`` bytes; a hash that two
   starts share is a repeat.

Windows are told apart by 64-bit hashes (plus bucket bits of a second hash at full depth), so results
are exact but for collisions.  Repeats inside a chunk of documents are folded before the exchange.

Defined results: a null text is empty; every row counts as a document of its own, so a repeated row
of at least ``min_bytes`` bytes is removed wholly; texts shorter than that lose nothing; ties do not
arise, since removal does not depend on order; a very long text is a chunk of its own and is held
whole, with some thirty times its size beside it; an empty table gives an empty one; input columns
travel in the struct ``row`` and cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import cells as C
from tidemill.llm.textvec import Rolling, mix, row_chunks, text_buffer

BYTES, SECOND = Rolling(21), Rolling(22, base=1)
ANCHOR = np.dtype([("k", "<u8"), ("e", "<u8"), ("uid", "<i8"), ("pos", "<u4"), ("gap", "<u2"), ("last", "<u2"), ("flag", "u1")])
#: Starts pos - gap to pos - last of a document; flag 1: all repeated, 2: to be told apart byte by byte.
STARTS = np.dtype([("uid", "<i8"), ("pos", "<u4"), ("gap", "<u2"), ("last", "<u2"), ("flag", "u1")])
LEAF = np.dtype([("k", "<u8"), ("uid", "<i8"), ("pos", "<u4"), ("flag", "u1")])
KNOWN, PASSED = 1, 2
BLOCK, PLACE = 1 << 23, np.uint64((1 << 24) - 1)


def sampling(min_bytes: int) -> tuple[int, int]:
    """Width of the anchor window, and the depth R that every window shares from its anchor on."""
    width = max(1, min(min_bytes - 8, min_bytes * 2 // 5))
    return width, min_bytes + 1 - width


def leftmost_minimum(buf: np.ndarray, width: int) -> np.ndarray:
    """For each position, where in the next ``width`` positions the least 8-byte hash first occurs."""
    n = len(buf) - 7 - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        m = to - at + width - 1
        grams = np.ndarray((m,), "<u8", buf, at, (1,)).astype(np.uint64)
        low = mix(grams) & ~PLACE | np.arange(m, dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: span - width], low[width - span :])
        out[at:to] = (low & PLACE).astype(np.int64) + at
    return out


def _shards(batches, min_bytes: int, buckets: int):
    width, depth = sampling(min_bytes)
    for t in row_chunks(batches):
        buf, offs = text_buffer(t.column("text"))
        room = np.maximum(np.diff(offs) - min_bytes + 1, 0)
        if not room.any():
            continue
        doc = np.repeat(np.arange(len(room)), room)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + offs[:-1][doc]
        anchor = leftmost_minimum(np.ascontiguousarray(buf), width)[at]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        end = np.r_[new[1:], len(at)] - 1
        x, lo, hi, doc = anchor[new], at[new], at[end], doc[new]
        prefix = BYTES.of_bytes(buf)
        out = np.empty(len(x), ANCHOR)
        out["k"] = BYTES.ranges(prefix, x, x + depth)
        shape = (x - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)
        out["e"] = mix(BYTES.ranges(prefix, lo, hi + min_bytes) ^ shape)
        out["uid"], out["pos"], out["gap"], out["last"], out["flag"] = C.ids(t.column("uid"))[doc], x - offs[doc], x - lo, x - hi, 0
        fresh, again = _folded(out["k"], out["e"])
        out["flag"][again] = KNOWN
        out["flag"][~fresh] = PASSED
        bucket = ((out["k"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        bucket[~fresh] = C.home(out["uid"][~fresh], buckets)
        yield C.packed(bucket, out)


def _folded(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each record in its place: is it the first with its two keys in the shard's order, and is it the first of several."""
    order = np.lexsort((two, one))
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    fresh, again = np.empty(len(one), bool), np.empty(len(one), bool)
    fresh[order] = new
    again[order] = new & np.r_[~new[1:], False]
    return fresh, again


def _merge(_, column, groups: int):
    a = C.unpacked(column, ANCHOR)
    passed = a["flag"] == PASSED
    done, own = a[passed], a[~passed]
    own = own[np.lexsort((own["e"], own["k"]))]
    n = len(own)
    flag = np.zeros(n, np.uint8)
    if n:
        new_k = np.r_[True, own["k"][1:] != own["k"][:-1]]
        new_e = new_k | np.r_[True, own["e"][1:] != own["e"][:-1]]
        part = np.cumsum(new_e) - 1
        whole = np.cumsum(new_k) - 1
        size = np.bincount(part) + np.bincount(part, own["flag"] == KNOWN)
        flag[size[part] > 1] = 1
        flag[new_e & (np.bincount(whole, new_e)[whole] > 1)] |= 2
    found = np.concatenate([own[flag > 0], done])
    out = np.empty(len(found), STARTS)
    for name in ("uid", "pos", "gap", "last"):
        out[name] = found[name]
    out["flag"] = np.r_[flag[flag > 0], np.ones(len(done), np.uint8)]
    yield C.packed(C.home(out["uid"], groups), out)


def _step_back(t: pa.Table, records: np.ndarray, min_bytes: int, buckets: int) -> pa.Table:
    buf, offs = text_buffer(t.column("text"))
    uid = C.ids(t.column("uid"))
    doc, at = C.located(uid, records)
    use = (records["flag"][at] & 2 > 0) & C.once(uid)[doc]
    doc, found = doc[use], records[at[use]]
    if not len(found):
        return C.EMPTY
    reps = (found["gap"] - found["last"]).astype(np.int64) + 1
    first = np.repeat(found["pos"].astype(np.int64) - found["gap"], reps)
    pos = first + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    at = pos + np.repeat(offs[doc], reps)
    out = np.empty(len(pos), LEAF)
    out["k"], out["uid"], out["pos"], out["flag"] = BYTES.ranges(BYTES.of_bytes(buf), at, at + min_bytes), np.repeat(found["uid"], reps), pos, 0
    bucket = (SECOND.ranges(SECOND.of_bytes(buf), at, at + min_bytes) % np.uint64(buckets)).astype(np.int32)
    fresh, again = _folded(out["k"], bucket)
    out["flag"][again] = KNOWN
    out["flag"][~fresh] = PASSED
    bucket[~fresh] = C.home(out["uid"][~fresh], buckets)
    return pa.Table.from_batches([C.packed(bucket, out)])


def _full_depth(bucket, column, groups: int):
    ids, a = C.with_buckets(bucket, column, LEAF)
    passed = a["flag"] == PASSED
    own, ids = a[~passed], ids[~passed]
    order = np.lexsort((ids, own["k"]))
    own, ids = own[order], ids[order]
    same = (own["k"][1:] == own["k"][:-1]) & (ids[1:] == ids[:-1])
    hit = (np.r_[False, same] | np.r_[same, False])[: len(own)] | (own["flag"] == KNOWN)
    found = np.concatenate([own[hit], a[passed]])
    out = np.zeros(len(found), STARTS)
    out["uid"], out["pos"], out["flag"] = found["uid"], found["pos"], 1
    yield C.packed(C.home(out["uid"], groups), out)


def _kept(t: pa.Table, records: np.ndarray, min_bytes: int, decoded: bool) -> pa.Table:
    buf, offs = text_buffer(t.column("text"))
    doc, at = C.located(C.ids(t.column("uid")), records)
    use = records["flag"][at] & 1 > 0
    doc, found = doc[use], records[at[use]]
    step = np.zeros(len(buf) + 1, np.int32)
    x = offs[doc] + found["pos"]
    np.add.at(step, x - found["gap"], 1)
    np.add.at(step, x - found["last"] + min_bytes, -1)
    drop = np.cumsum(step[: len(buf)]) > 0
    full = offs[:-1][np.diff(offs) > 0]
    open_, close = drop.copy(), drop.copy()
    if len(buf):
        open_[1:] &= ~drop[:-1]
        open_[full] = drop[full]
        close[:-1] &= ~drop[1:]
        ends = offs[1:][np.diff(offs) > 0] - 1
        close[ends] = drop[ends]
    starts, stops = np.flatnonzero(open_), np.flatnonzero(close) + 1
    spans = np.searchsorted(starts, offs)
    base = np.repeat(offs[:-1], np.diff(spans))
    at = np.r_[0, np.cumsum(~drop)][offs]
    data = buf[~drop].tobytes()
    kept = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    listed = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(stops - base, pa.int64())], ["start", "end"])
    return pa.table({
        "row": t.column("row"),
        **({"text": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())} if decoded else {"kept": pa.array(kept, pa.binary())}),
        "spans": pa.ListArray.from_arrays(pa.array(spans, pa.int32()), listed),
        "n_bytes": pa.array(np.diff(offs), pa.int64()),
        "n_removed": pa.array(np.diff(offs) - np.diff(at), pa.int64()),
        "n_spans": pa.array(np.diff(spans), pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
    })


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 400, decoded: bool = False) -> DataFrame:
    """Each input row as ``row`` (without its text) with the ``kept`` bytes, removed spans, n_bytes, n_removed, n_spans and kept_sha256.

    With ``decoded``, ``text`` in place of ``kept``: a character that is cut in part is left out.
    """
    buckets, groups = C.dealt(docs, text_col)
    rows = C.with_home(C.addressed(docs, id_col, text_col), groups)
    shards = C.texts(docs, id_col, text_col).mapInArrow(lambda b: _shards(b, min_bytes, buckets), C.CELLS)
    merged = C.save(C.gathered(shards, lambda b, c: _merge(b, c, groups), buckets=buckets), "bwt-intervals")
    leaves = C.beside(rows, merged, lambda t, found: _step_back(t, found, min_bytes, buckets), C.CELLS, STARTS)
    starts = C.gathered(leaves, lambda b, c: _full_depth(b, c, groups), buckets=buckets).union(merged)
    schema = T.StructType([rows.schema["row"]]).add(*(("text", "string") if decoded else ("kept", "binary"))).add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    return C.beside(rows, starts, lambda t, found: _kept(t, found, min_bytes, decoded), schema, STARTS)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
