"""Substring dedup by difference-cover anchors.

A difference cover D modulo v holds, for any two positions, an offset below v that takes both into
D.  So two equal windows of w words always share an aligned anchor: a sub-window of w - v + 1 words
that starts at a cover position in both.  Three steps, each exact:

1. hash the sub-windows at cover positions only (4 of 13 positions for w = 20) and find those that
   occur more than once anywhere;
2. extend: each window start within reach of such an anchor hashes its whole window, and equal
   windows are ordered by (document id, start); all but the first are marked;
3. each document drops the words that its marked windows cover.

Records travel as packed cells (``cells``).  Repeats inside a chunk of documents are folded before
the exchange, so a passage that a third of all documents share costs a record per chunk.

Defined results: a null text has no words; a null id sorts before all ids; rows with equal id and
text are one document listed twice and get equal results; rows with one id but different texts are
told apart by the text's hash; texts shorter than the window lose nothing; a very long text counts
whole, as a chunk of its own (positions are 30 bits of words); an empty table gives an empty one; input
columns travel in the struct ``row`` and cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import cells as C
from tidemill.llm.textvec import Rolling, Words, covered, row_chunks, text_buffer, window_starts

#: Perfect difference sets, period -> members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (0, 1, 3, 8, 12, 18)}

WORD, SEQ = Rolling(11), Rolling(12)
ANCHOR = np.dtype([("k", "<u4"), ("uid", "<i8"), ("pos", "<u4")])
CANDIDATE = np.dtype([("uid", "<i8"), ("pos", "<u4")])
WINDOW = np.dtype([("k", "<u8"), ("doc", "<i8"), ("low", "<u4"), ("pos", "<u4")])
MARK = np.dtype([("doc", "<i8"), ("low", "<u4"), ("pos", "<u4")])
KNOWN, PASSED = np.uint32(1 << 31), np.uint32(1 << 30)
POSITION = np.uint32((1 << 30) - 1)


def period(window: int) -> int:
    """The largest period that leaves an anchor of at least a third of the window."""
    return max([v for v in COVERS if window - v + 1 >= max(1, window // 3)], default=1)


def _sequence(buf, words):
    return SEQ.prefix(WORD.ranges(WORD.of_bytes(buf), words.start, words.end))


def _anchors(batches, window: int, buckets: int):
    v = period(window)
    cover, sub = np.zeros(v, bool), window - v + 1
    cover[list(COVERS.get(v, (0,)))] = True
    for t in row_chunks(batches):
        buf, offs = text_buffer(t.column("text"))
        words = Words(buf, offs)
        at = window_starts(words.bounds, sub)
        index, doc = words.index(), words.doc()
        at = at[cover[index[at] % v] & (words.counts[doc[at]] >= window)]
        if not len(at):
            continue
        key = SEQ.ranges(_sequence(buf, words), at, at + sub)
        fresh, again = _folded(key)
        out = np.empty(len(at), ANCHOR)
        out["k"], out["uid"], out["pos"] = key & np.uint64(0xFFFFFFFF), C.ids(t.column("uid"))[doc[at]], index[at]
        out["pos"][again] |= KNOWN
        out["pos"][~fresh] |= PASSED
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        bucket[~fresh] = C.home(out["uid"][~fresh], buckets)
        yield C.packed(bucket, out)


def _folded(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each record in its place: is it the first of its key, and is it the first of several."""
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.zeros(0, bool)
    fresh, again = np.empty(len(key), bool), np.empty(len(key), bool)
    fresh[order] = new
    again[order] = new & np.r_[~new[1:], False] if len(key) else new
    return fresh, again


def _repeated(bucket, column, groups: int):
    ids, a = C.with_buckets(bucket, column, ANCHOR)
    passed = a["pos"] & PASSED > 0
    own = a[~passed]
    key = ids[~passed].astype(np.uint64) << np.uint64(32) | own["k"]
    order = np.argsort(key, kind="stable")
    own, key = own[order], key[order]
    same = key[1:] == key[:-1]
    hit = np.r_[False, same] | np.r_[same, False] | (own["pos"] & KNOWN > 0)
    found = np.concatenate([own[hit], a[passed]])
    out = np.empty(len(found), CANDIDATE)
    out["uid"], out["pos"] = found["uid"], found["pos"] & POSITION
    yield C.packed(C.home(out["uid"], groups), out)


def _windows(t: pa.Table, found: np.ndarray, window: int, buckets: int) -> pa.Table:
    v = period(window)
    buf, offs = text_buffer(t.column("text"))
    words = Words(buf, offs)
    uid = C.ids(t.column("uid"))
    own, at = C.located(uid, found)
    near = np.zeros(len(words.start) + 1, np.int64)
    near[words.bounds[own] + found["pos"][at]] = 1
    near = np.r_[0, np.cumsum(near)]
    at = window_starts(words.bounds, window)
    at = at[near[np.minimum(at + v, len(near) - 1)] > near[at]]
    doc = words.doc()[at]
    first = C.once(uid)[doc]
    at, doc = at[first], doc[first]
    if not len(at):
        return C.EMPTY
    out = np.empty(len(at), WINDOW)
    out["k"], out["doc"], out["low"], out["pos"] = SEQ.ranges(_sequence(buf, words), at, at + window), C.ids(t.column("doc_id"))[doc], uid[doc] & 0xFFFFFFFF, words.index()[at]
    order = np.lexsort((out["pos"], out["low"], out["doc"], out["k"]))
    late = np.zeros(len(out), bool)
    late[order[1:]] = out["k"][order[1:]] == out["k"][order[:-1]]
    out["pos"][late] |= PASSED
    bucket = ((out["k"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    bucket[late] = C.home(out["low"][late], buckets)
    return pa.Table.from_batches([C.packed(bucket, out)])


def _ordered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by window, document and start; true for all but the first of equal windows."""
    a = a[np.lexsort((a["pos"], a["low"], a["doc"], a["k"]))]
    return a, np.r_[False, a["k"][1:] == a["k"][:-1]] if len(a) else np.zeros(0, bool)


def _later(_, column, groups: int):
    a = C.unpacked(column, WINDOW)
    passed = a["pos"] & PASSED > 0
    own, late = _ordered(a[~passed])
    found = np.concatenate([own[late], a[passed]])
    out = np.empty(len(found), MARK)
    out["doc"], out["low"], out["pos"] = found["doc"], found["low"], found["pos"] & POSITION
    yield C.packed(C.home(out["low"], groups), out)


def _kept(t: pa.Table, found: np.ndarray, window: int) -> pa.Table:
    buf, offs = text_buffer(t.column("text"))
    words = Words(buf, offs)
    own = np.empty(t.num_rows, [("doc", "<i8"), ("low", "<u4")])
    own["doc"], own["low"] = C.ids(t.column("doc_id")), C.ids(t.column("uid")) & 0xFFFFFFFF
    doc, at = C.located(own, found)
    drop = covered(len(words.start), words.bounds[doc] + found["pos"][at], window)
    keep = ~drop
    kept_before = np.r_[0, np.cumsum(keep)]
    n_kept = kept_before[words.bounds[1:]] - kept_before[words.bounds[:-1]]
    index = kept_before[:-1] - np.repeat(kept_before[words.bounds[:-1]], words.counts)
    out, step = buf.copy(), np.zeros(len(buf) + 1, np.int8)
    start = words.start - (index > 0)
    out[start[keep & (index > 0)]] = 0x20
    np.add.at(step, start[keep], 1)
    np.add.at(step, words.end[keep], -1)
    take = np.cumsum(step[: len(buf)], dtype=np.int8) > 0
    at = np.r_[0, np.cumsum(take)][offs]
    data = out[take].tobytes()
    texts = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return pa.table({
        "row": t.column("row"),
        "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
        "n_words": pa.array(words.counts, pa.int64()),
        "n_removed": pa.array(words.counts - n_kept, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
    })


def cover_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Each input row as ``row`` (without its text) with kept_text, n_words, n_removed and kept_sha256."""
    buckets, groups = C.dealt(docs, text_col)
    rows = C.with_home(C.addressed(docs, id_col, text_col), groups)
    anchors = C.texts(docs, id_col, text_col).mapInArrow(lambda b: _anchors(b, window, buckets), C.CELLS)
    candidates = C.save(C.gathered(anchors, lambda b, c: _repeated(b, c, groups), buckets=buckets), "cover-candidates")
    windows = C.beside(rows, candidates, lambda t, found: _windows(t, found, window, buckets), C.CELLS, CANDIDATE)
    marks = C.gathered(windows, lambda b, c: _later(b, c, groups), buckets=buckets)
    schema = T.StructType([rows.schema["row"]]).add("kept_text", "string").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return C.beside(rows, marks, lambda t, found: _kept(t, found, window), schema, MARK)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cover_dedup(docs).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
