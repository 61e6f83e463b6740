"""SimHash near-dedup with multi-index hashing.

A fingerprint has a bit set where more than half of a text's shingle hashes have it.  Fingerprints
within ``radius`` bits are cut into m equal segments; one segment then differs in at most
floor(radius / m) bits.  Each distinct fingerprint enters a table once per segment, and queries it
with the small Hamming ball around its own segment; as the search is symmetric, only flips from 0
to 1 are enumerated.  Fingerprints that meet under a segment value are compared in full.

Equal fingerprints are folded before anything else.  A segment value that very many distinct
fingerprints share is dealt to several tasks as pairs of blocks, so each task compares a bounded
number.  Tasks send on only links that join what was apart, so links stay fewer than members.

Defined results: null and wordless texts have fingerprint zero and link like any other; ids may
repeat or be null (a component of null ids only has a null id); repeated rows share a component; a very
long text counts whole and is held alone; ties (equal fingerprints) fold to one and all get its
component; an empty table gives an empty one; input columns travel in ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import cells as C
from tidemill.llm.cells import partitions, save
from tidemill.llm.graph import components, spanning
from tidemill.llm.textvec import Words, mix, row_chunks, text_buffer

#: Members of a segment value that one task compares with each other, or with as many others.
BLOCK = 256
#: Rows of such pairs of blocks that a task compares at once.
HELD = 1 << 16
SEED = 42

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined_words(buf: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Case-folded words joined by one space: the bytes, each word's start and end in them, and word bounds by text."""
    words = Words(buf, offs)
    first = np.zeros(len(words.start), bool)
    first[words.bounds[:-1][words.counts > 0]] = True
    out = _LOWER[buf]
    start = words.start - ~first
    out[start[~first]] = 0x20
    step = np.zeros(len(buf) + 1, np.int8)
    np.add.at(step, start, 1)
    np.add.at(step, words.end, -1)
    at = np.cumsum(step[: len(buf)], dtype=np.int8) > 0
    place = np.r_[0, np.cumsum(at)]
    return out[at].tobytes(), place[words.start], place[words.end], words.bounds


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, repeats included, and bounds by text; fewer words than that make one shingle."""
    data, start, end, bounds = joined_words(buf, offs)
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.r_[0, np.cumsum(n)]
    at = np.repeat(bounds[:-1], n) + np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], n)
    last = np.minimum(at + size, np.repeat(bounds[1:], n)) - 1
    h = xxhash.xxh64_intdigest
    found = np.fromiter((h(data[a:b], SEED) for a, b in zip(start[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
    return found, out_bounds


def fingerprint(hashes: np.ndarray, bounds: np.ndarray, words: int = 1) -> np.ndarray:
    """(texts, words) of 64 majority bits each; zero without any hash.  Words after the first use mixed hashes."""
    out = np.zeros((len(bounds) - 1, words), np.uint64)
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    for w in range(words if len(full) else 0):
        h = mix(hashes + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if w else hashes
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[full], axis=0, dtype=np.int32)
        out[full, w] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def names(words: int) -> list[str]:
    return [f"fp{w}" for w in range(words)]


def distinct_shingles(hashes: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted set of each text's hashes, and bounds by text."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return sets, np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int64)


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, text_col: str = "text", sets: int | None = None) -> DataFrame:
    """Each input row as ``row`` (without its text) with ``fp0``, ``fp1``, ... (long).

    With ``sets``, of distinct shingles, and with their number ``n``, a ``digest`` of their set, and the
    set itself in ``few`` if it has at most so many.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for t in row_chunks(batches):
            h, bounds = shingles(*text_buffer(t.column("text")), size)
            more = {}
            if sets is not None:
                held, bounds = distinct_shingles(h, bounds)
                h = np.concatenate([np.zeros(0, np.uint64), *held])
                few = [x.tobytes() if 0 < len(x) <= sets else None for x in held]
                digest = [xxhash.xxh3_128_digest(x.tobytes()) for x in held]
                more = {"n": pa.array(np.diff(bounds)), "digest": pa.array(digest, pa.binary()), "few": pa.array(few, pa.binary())}
            fp = fingerprint(h, bounds, words).view(np.int64)
            yield from pa.table({"row": t.column("row"), **{k: pa.array(np.ascontiguousarray(fp[:, w])) for w, k in enumerate(names(words))}, **more}).to_batches()

    schema = T.StructType([rows.schema["row"]])
    for k in names(words):
        schema = schema.add(k, "long")
    if sets is not None:
        schema = schema.add("n", "long").add("digest", "binary").add("few", "binary")
    return rows.mapInArrow(run, schema)


def _ball(segment, width: int, radius: int) -> list:
    """Columns: the segment with every set of at most ``radius`` of its zero bits set; null where a bit is not zero."""
    found = [segment]
    chosen: list[list[int]] = [[]]
    for _ in range(radius):
        chosen = [[*c, b] for c in chosen for b in range(c[-1] + 1 if c else 0, width)]
        for c in chosen:
            mask = sum(1 << b for b in c)
            found.append(F.when(segment.bitwiseAND(F.lit(mask)) == 0, segment.bitwiseOR(F.lit(mask))))
    return found


def near_pairs(distinct: DataFrame, words: int, radius: int, segments: list[tuple[int, int, int]]) -> DataFrame:
    """Edges (a, b) that span the groups of fingerprints within ``radius`` bits, nearest pairs first.

    ``distinct`` has node (long) and the fingerprint's words.  A segment is (word, first bit, bits); the
    table is searched with balls of radius 1.  If the segments cover all bits and are more than half of
    radius + 1, no pair is missed; other choices find a pair if one of its segments differs in a bit at most.
    """
    fp = names(words)
    parts = []
    for number, (word, shift, bits) in enumerate(segments):
        segment = F.shiftrightunsigned(fp[word], shift).bitwiseAND(F.lit((1 << bits) - 1))
        keys = F.array(*[F.struct(F.lit(i == 0).alias("table"), k.alias("key")) for i, k in enumerate(_ball(segment, bits, 1))])
        parts.append(distinct.select("node", *fp, F.lit(number).alias("seg"), F.explode(keys).alias("m")).where("m.key is not null").select("seg", "m.key", "m.table", "node", *fp))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.union(p)
    size = all_.groupBy("seg", "key").agg(F.count("*").alias("n"), F.max("table").alias("held")).where("n > 1 and held")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    # a merge: Spark's estimate of an exploded table does not count its repeats, and it would broadcast them
    met = save(all_.join(size.hint("merge"), ["seg", "key"]).select("seg", "key", "node", *fp, blocks.alias("blocks")), "mih-members")
    return _blocked(met, words, radius)


def _linked(group: np.ndarray, node: np.ndarray, bits: np.ndarray, radius: int, n: np.ndarray | None = None, similarity: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the groups of near fingerprints among rows sorted by ``group``, nearest first."""
    left, right, far = [], [], []
    at = np.arange(len(node))
    for step in range(1, len(node)):
        at = at[at < len(node) - step]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        some = at[node[at] != node[at + step]]
        if n is not None:  # sets of such sizes cannot be that similar
            some = some[np.minimum(n[some], n[some + step]) >= similarity * np.maximum(n[some], n[some + step])]
        distance = np.bitwise_count(bits[some] ^ bits[some + step]).sum(1, dtype=np.int32)
        hit = distance <= radius
        left.append(some[hit])
        right.append(some[hit] + step)
        far.append(distance[hit])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right, far = np.concatenate(left), np.concatenate(right), np.concatenate(far)
    all_nodes, place = np.unique(node, return_inverse=True)
    a, b = spanning(len(all_nodes), ((place[left[far == d]], place[right[far == d]]) for d in np.unique(far)))
    return all_nodes[a], all_nodes[b]


#: A segment value with more records than this is dealt to several tasks.
LARGE = 4096


def near_cells(distinct: DataFrame, words: int, radius: int, segments: list[tuple[int, int, int]], large: int = LARGE, similarity: float = 0) -> DataFrame:
    """As ``near_pairs``, for many segments (of an even number of bits, 30 at most): records travel as packed cells and are compared where they meet.

    Segments within a bit agree in one of their halves, so a record goes to one task for each half, and
    balls are made there.

    Segment values with very many records come out as members and are dealt as pairs of blocks.  With a
    column ``n``, the size of a set, pairs are left out whose sizes exclude that ``similarity``.
    """
    sized = "n" in distinct.columns
    fp = names(words)
    record = np.dtype([("route", "<u4"), ("n", "<u4"), ("node", "<i8"), ("fp", "<u8", (words,))])
    buckets = C.buckets_for(distinct.sparkSession, distinct.count() * 2 * len(segments) * record.itemsize)
    word_of, shift_of, size_of = (np.array(c) for c in zip(*segments, strict=True))

    def spread(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                node, n = b.column(0).to_numpy(), b.column(1).to_numpy()
                bits = np.stack([b.column(2 + w).to_numpy().view(np.uint64) for w in range(words)], axis=1)
                for number, (word, shift, size) in enumerate(segments):
                    value = bits[:, word] >> np.uint64(shift) & np.uint64((1 << size) - 1)
                    for half, part in enumerate((value & np.uint64((1 << size // 2) - 1), value >> np.uint64(size // 2))):
                        out = np.empty(len(node), record)
                        out["route"] = part | np.uint64(2 * number + half << 16)
                        out["node"], out["n"], out["fp"] = node, np.minimum(n, 0xFFFFFFFF), bits
                        if len(out):
                            yield C.packed((mix(out["route"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32), out)

    def meet(_, column):
        a = C.unpacked(column, record)
        number, half = (a["route"] >> 17).astype(np.int64), a["route"] >> 16 & 1
        value = a["fp"][np.arange(len(a)), word_of[number]] >> shift_of[number].astype(np.uint64) & (np.uint64(1) << size_of[number].astype(np.uint64)) - np.uint64(1)
        base = (a["route"] >> 16).astype(np.uint64) << np.uint64(32)
        keys, rows = [value | base], [np.arange(len(a))]
        for bit in range(int(size_of.max())):  # flips in the half that did not choose the route
            flip = np.flatnonzero(((bit >= size_of[number] // 2) == (half == 0)) & (bit < size_of[number]) & (value >> np.uint64(bit) & np.uint64(1) == 0))
            keys.append(value[flip] | np.uint64(1 << bit) | base[flip])
            rows.append(flip)
        k, at = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(k, kind="stable")
        table = order < len(a)
        k, at = k[order], at[order]
        del keys, rows, order
        new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        n = np.bincount(group)
        use = (n > 1) & (np.bincount(group, table) > 0)
        crowd = use[group] & (n[group] > large)
        crowded, crowd_key = a[at[crowd]], k[crowd]
        some = use[group] & ~crowd
        a, group = a[at[some]], group[some]
        left, right = _linked(group, a["node"], a["fp"], radius, a["n"].astype(np.int64) if sized else None, similarity)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.list_(pa.int64()))], ["a", "b", "key", "fp"])
        if len(crowded):
            flat = pa.array(np.ascontiguousarray(crowded["fp"]).view(np.int64).ravel())
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(crowded) + 1) * words, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(crowded["node"]), pa.array(crowded["n"].astype(np.int64)), pa.array(crowd_key.view(np.int64)), bits], ["a", "b", "key", "fp"])

    made = distinct.select("node", (F.col("n") if sized else F.lit(0)).cast("long").alias("n"), *fp).mapInArrow(spread, C.CELLS)
    met = save(C.gathered(made, meet, "a long, b long, key long, fp array<long>", buckets), "mih-met")
    edges = met.where("key is null").select("a", "b")
    crowds = met.where("key is not null")
    if crowds.isEmpty():
        return edges
    size = crowds.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    carried = [F.col("b").alias("n")] if sized else []
    members = crowds.join(size, "key").select(F.lit(0).alias("seg"), "key", F.col("a").alias("node"), *carried, *[F.col("fp")[w].alias(k) for w, k in enumerate(fp)], "blocks")
    return edges.union(_blocked(members, words, radius, similarity))


def _tasks(met: DataFrame, carried: list[str]) -> DataFrame:
    """The members of each segment value, once for each pair of their ``blocks`` blocks, with the ``task`` of that pair."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = met.select("seg", "key", *carried, mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return pair.select(F.xxhash64("seg", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), *carried)


def _blocked(met: DataFrame, words: int, radius: int, similarity: float = 0) -> DataFrame:
    """Edges among the members of each segment value, dealt as pairs of ``blocks`` blocks."""
    fp, sized = names(words), "n" in met.columns
    task = _tasks(met, ["node", *(["n"] if sized else []), *fp])

    def edges_of(held):
        t = pa.Table.from_batches(held)
        group, node = t.column("task").to_numpy(), t.column("node").to_numpy()
        order = np.lexsort((node, group))
        group, node = group[order], node[order]
        bits = np.stack([t.column(k).to_numpy()[order].view(np.uint64) for k in fp], axis=1)
        a, b = _linked(group, node, bits, radius, t.column("n").to_numpy()[order] if sized else None, similarity)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def compare(batches):
        """Rows come sorted by task: as many whole tasks at once as make HELD rows."""
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                if rows + batch.num_rows < HELD:
                    held.append(batch)
                    rows += batch.num_rows
                    break
                own = batch.column(0).to_numpy()
                last = int(np.searchsorted(own, own[-1]))  # where the batch's last task begins
                if last == 0 and held and held[-1].column(0)[-1].as_py() != own[0]:
                    yield edges_of(held)
                    held, rows = [], 0
                    continue
                if last == 0:  # one task goes on
                    held.append(batch)
                    rows += batch.num_rows
                    break
                yield edges_of([*held, batch.slice(0, last)])
                held, rows, batch = [], 0, batch.slice(last)
        if held:
            yield edges_of(held)

    buckets = C.buckets_for(met.sparkSession, task.count() * (len(fp) + 3) * 8)
    return task.repartition(buckets, "task").sortWithinPartitions("task").mapInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each input row as ``row`` (without its text) with fp0 and ``component``: the least id of its group.

    Fingerprints of 64 bits link at 3 bits or fewer; two segments of 32 bits miss no pair.
    """
    rows = save(fingerprints(docs, size, 1, text_col), "fingerprints")
    nodes = rows.groupBy("fp0").agg(F.min(F.col("row").getField(id_col).cast("long")).alias("least"))
    edges = near_pairs(nodes.select(F.col("fp0").alias("node"), "fp0"), 1, 3, [(0, 0, 32), (0, 32, 32)])
    roots = components(edges)
    joined = nodes.join(roots.withColumnRenamed("node", "fp0"), "fp0", "left").select("fp0", "least", F.coalesce("root", "fp0").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    return rows.hint("merge").join(joined.join(least, "root").select("fp0", "component"), "fp0").select("row", "fp0", "component")


#: Words of the long fingerprint, its radius, and segments of 16 bits, two from each word.
LONG_WORDS, LONG_RADIUS = 4, 56
LONG_SEGMENTS = [(w, shift, 16) for w in range(LONG_WORDS) for shift in (0, 16, 32, 48)]
#: Fingerprints of few shingles tell little: pairs whose smaller set has no more are searched by the shingles themselves.
SHORT = 24


def _similar(group: np.ndarray, node: np.ndarray, n: np.ndarray, sets: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the groups of similar sets (rows of hashes, filled with zeros) among rows sorted by ``group``, all checked."""
    left, right = [], []
    at = np.arange(len(node))
    for step in range(1, len(node)):
        at = at[at < len(node) - step]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        a, b = at, at + step
        some = (node[a] != node[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]))
        for a in np.array_split(a[some], int(some.sum()) // 16384 + 1):
            b = a + step
            both = np.sort(np.concatenate([sets[a], sets[b]], axis=1), axis=1)
            common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != 0)).sum(1)
            hit = common >= similarity * (n[a] + n[b] - common)
            left.append(node[a[hit]])
            right.append(node[b[hit]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = np.concatenate(left), np.concatenate(right)
    names, place = np.unique(np.r_[left, right], return_inverse=True)
    a, b = spanning(len(names), [(place[: len(left)], place[len(left) :])])
    return names[a], names[b]


def short_links(sets: DataFrame, similarity: float, large: int = LARGE) -> DataFrame:
    """Edges (a, b) that span the groups of similar sets; ``sets`` has node and set (sorted 64-bit hashes), of SHORT / similarity at most.

    Of two similar sets the first n - ceil(similarity * n) + 1 hashes have one in common: no pair is missed.
    """
    width = int(SHORT / similarity + 1e-9)
    record = np.dtype([("k", "<u8"), ("node", "<i8"), ("n", "<i8"), ("set", "<u8", (width,))])
    buckets = C.buckets_for(sets.sparkSession, sets.count() * (width - int(similarity * width) + 1) * record.itemsize)

    def spread(batches):
        for b in batches:
            held = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(1)]
            n = np.array([len(x) for x in held], np.int64)
            first = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
            at = np.repeat(np.arange(len(held)), first)
            out = np.zeros(len(at), record)
            if len(out):
                filled = np.zeros((len(held), width), np.uint64)
                for i, x in enumerate(held):
                    filled[i, : len(x)] = x
                out["k"] = filled[at, np.arange(len(at)) - np.repeat(np.cumsum(first) - first, first)]
                out["node"], out["n"], out["set"] = b.column(0).to_numpy()[at], n[at], filled[at]
                yield C.packed((mix(out["k"]) % np.uint64(buckets)).astype(np.int32), out)

    def meet(_, column):
        a = C.unpacked(column, record)
        a = a[np.lexsort((a["n"], a["k"]))]
        group = np.cumsum(np.r_[True, a["k"][1:] != a["k"][:-1]]) - 1
        crowd = np.bincount(group)[group] > large
        crowded, a, group = a[crowd], a[~crowd], group[~crowd]
        left, right = _similar(group, a["node"], a["n"], a["set"], similarity)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.binary())], ["a", "b", "key", "set"])
        if len(crowded):
            sets_ = pa.array([x.tobytes() for x in crowded["set"]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(crowded["node"]), pa.array(crowded["n"]), pa.array(crowded["k"].view(np.int64)), sets_], ["a", "b", "key", "set"])

    met = save(C.gathered(sets.select("node", "set").mapInArrow(spread, C.CELLS), meet, "a long, b long, key long, set binary", buckets), "short-met")
    edges, crowds = met.where("key is null").select("a", "b"), met.where("key is not null")
    if crowds.isEmpty():
        return edges
    blocks = crowds.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = crowds.join(blocks, "key").select(F.lit(0).alias("seg"), "key", F.col("a").alias("node"), F.col("b").alias("n"), "set", "blocks")

    def compare(t: pa.Table) -> pa.Table:
        filled = np.frombuffer(b"".join(x.as_py() for x in t.column("set")), np.uint64).reshape(-1, width)
        a, b = _similar(np.zeros(t.num_rows, np.int64), t.column("node").to_numpy(), t.column("n").to_numpy(), filled, similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return edges.union(_tasks(members, ["node", "n", "set"]).groupBy("task").applyInArrow(compare, "a long, b long"))


def _set_links(t: pa.Table, similarity: float) -> pa.Table:
    """Edges that span the links between the rows to ask about and the others of one task (columns node, root, ask, set), all pairs of different roots checked."""
    node, root, ask = t.column("node").to_numpy(), t.column("root").to_numpy(), t.column("ask").to_numpy(zero_copy_only=False)
    held = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
    size = np.array([len(x) for x in held])
    asked, data = np.flatnonzero(ask), np.flatnonzero(~ask)
    left, right = [], []
    words = np.unique(np.concatenate([held[i] for i in asked])) if len(asked) else np.zeros(0, np.uint64)
    step = max(1, CELL // max(1, len(words)))
    for i in range(0, len(asked), step):
        some = asked[i : i + step]
        table = np.zeros((len(words) + 1, len(some)), np.uint8)
        for k, x in enumerate(some):
            table[np.searchsorted(words, held[x]), k] = 1
        at = 0
        while at < len(data):
            to = at + max(1, int(np.searchsorted(np.cumsum(size[data[at:]]), CELL // len(some))))
            here = data[at:to]
            flat = np.concatenate([held[x] for x in here])
            place = np.minimum(np.searchsorted(words, flat), len(words) - 1)
            place[words[place] != flat] = len(words)  # a row of zeros
            common = np.add.reduceat(table[place], np.r_[0, np.cumsum(size[here])[:-1]], axis=0, dtype=np.int32)
            hit = (common >= similarity * (size[here][:, None] + size[some] - common)) & (root[here][:, None] != root[some])
            x, y = np.nonzero(hit)
            left.append(node[here[x]])
            right.append(node[some[y]])
            at = to
    a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (left, right))
    every, place = np.unique(np.r_[a, b], return_inverse=True)
    a, b = spanning(len(every), [(place[: len(a)], place[len(a) :])])
    return pa.table({"a": pa.array(every[a], pa.int64()), "b": pa.array(every[b], pa.int64())})


#: Cells of the tables that compare sets at once, and bytes of the sets that a block holds: a group's sets travel once for each such block of it.
CELL, BLOCK_BYTES = 1 << 23, 1 << 23


def _open_links(failed: DataFrame, roots: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between linked parts that the spanning edges could not tell.

    ``failed`` has the parts (root_a, root_b) at the two ends of the candidate edges that are no links, ``roots``
    node and root.  Parts that such edges join form a group.  Its members outside the largest part are
    asked about against all its members, in blocks, by their whole sets.
    """
    groups = components(failed).select(F.col("node").alias("root"), F.col("root").alias("group"))
    member = save(groups.join(roots, "root", "left").select("group", "root", F.coalesce("node", "root").alias("node")).join(held.withColumnRenamed("uid", "node"), "node"), "open-members")
    size = F.octet_length("set").cast("long") + 64
    parts = member.groupBy("group", "root").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    largest = parts.groupBy("group").agg(F.max(F.struct("n", "root", "bytes")).alias("top"), F.sum("bytes").alias("all"))
    share = lambda b: F.greatest(F.lit(1), F.ceil(b / BLOCK_BYTES)).cast("int")
    blocks = largest.select("group", F.col("top.root").alias("top"), share(F.col("all")).alias("blocks"), share(F.col("all") - F.col("top.bytes")).alias("asks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("asks")).cast("int")
    each = member.join(blocks, "group")
    data = each.select("group", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("j"), "node", "root", F.lit(False).alias("ask"), "set")
    asked = each.where("root <> top").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), own.alias("j"), "node", "root", F.lit(True).alias("ask"), "set")
    # dealt by pair of blocks: a large group is many tasks
    dealt = data.union(asked).repartition(partitions(held.sparkSession), "group", "i", "j")
    return dealt.groupBy("group", "i", "j").applyInArrow(lambda t: _set_links(t, similarity), "a long, b long")


def _between(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of different roots at the ends of the edges; a node without a root is its own."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        edges = edges.join(own, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """Each input row whole as ``row`` with ``root``: equal for texts of one near-duplicate group, and ``first``: true for the one to keep.

    Texts link if their sets of word shingles have at least that similarity (Jaccard).  64 bits cannot
    tell 0.8 from less, so the fingerprint has 256 bits: 0.8 is some 39 differing bits, 56 misses about
    one in a thousand.  It is that of distinct shingles, and only texts of equal sets fold unchecked.  All sixteen
    16-bit segments are searched; one is within a bit for some 99 % of pairs at 0.8.  Pairs of which one
    has SHORT shingles or fewer are found by the shingles themselves, all of them.
    The nearest pairs that span each group of candidates are checked exactly before they link; where one
    of them fails, all pairs of its group that are still apart are checked (``_open_links``).

    Defined results: null and wordless texts have the empty set and are one group; the row to keep has
    the longest text, then the least row hash; rows equal in all columns come back once; input columns
    cannot clash, since they travel in ``row``; an empty table gives an empty one.
    """
    fp = names(LONG_WORDS)
    few = int(SHORT / similarity + 1e-9)
    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    hashes = [F.xxhash64("row").alias("uid"), F.xxhash64(F.lit(1), "row").alias("twin")]
    made = fingerprints(key.select(*hashes, F.length("text").alias("size"), "text"), size, LONG_WORDS, sets=few)
    rows = save(made.select("row.*", *fp, "n", "digest", "few"), "fingerprints")
    nodes = save(rows.groupBy("digest").agg(F.min("uid").alias("node"), *[F.first(k).alias(k) for k in (*fp, "n", "few")]), "nodes")

    def checked(batches):
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                near.append(common >= similarity * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.bool_())], ["a", "b", "near"])

    alone = save(short_links(nodes.where("few is not null").select("node", F.col("few").alias("set")), similarity).distinct(), "short-links")
    edges = save(near_cells(nodes, LONG_WORDS, LONG_RADIUS, LONG_SEGMENTS, similarity=similarity).distinct(), "near-edges")
    asked = docs.sparkSession.sparkContext.broadcast(C.marked(edges.select(F.explode(F.array("a", "b")).alias("uid"))))  # of fixed size

    def sets(batches):
        for t in row_chunks(batches):
            t = t.filter(pa.array(C.has_mark(asked.value, C.ids(t.column("uid")))))
            if t.num_rows:
                found = distinct_shingles(*shingles(*text_buffer(t.column("text")), size))[0]
                yield pa.RecordBatch.from_arrays([t.column("uid").combine_chunks(), pa.array([x.tobytes() for x in found], pa.binary())], ["uid", "set"])

    wanted = key.select(F.xxhash64("row").alias("uid"), "text").mapInArrow(sets, "uid long, set binary")
    held = save(wanted.groupBy("uid").agg(F.first("set").alias("set")), "shingle-sets")
    both = edges.join(held.select(F.col("uid").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("uid").alias("b"), F.col("set").alias("y")), "b")
    tried = save(both.select("a", "b", "x", "y").mapInArrow(checked, "a long, b long, near boolean"), "near-tried")
    roots = save(components(alone.union(tried.where("near").select("a", "b"))), "roots")
    failed = save(_between(tried.where(~F.col("near")).select("a", "b"), roots), "open-edges")
    grouped = nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    if not failed.isEmpty():
        found = save(_open_links(failed, roots, held, similarity), "open-links")
        upper = components(_between(found, roots)).select(F.col("node").alias("root"), F.col("root").alias("upper"))
        grouped = grouped.join(upper, "root", "left").select("digest", F.coalesce("upper", "root").alias("root"))
    best = F.max(F.struct("size", (-F.col("uid").cast("decimal(20,0)")).alias("low"))).alias("best")
    member = save(rows.select("uid", "twin", F.coalesce("size", F.lit(0)).alias("size"), "digest").join(grouped, "digest").select("uid", "twin", "size", "root"), "groups")
    kept = member.groupBy("root").agg(best).select("root", (-F.col("best.low")).cast("long").alias("kept"))
    chosen = save(member.join(kept, "root").groupBy("uid", "twin").agg(F.first("root").alias("root"), F.first(F.col("uid") == F.col("kept")).alias("first"), F.count("*").alias("times")), "chosen")
    # what was chosen is the built side, so rows pass by unsorted; only rows that are listed twice are folded
    whole = key.select("row").select(*hashes, "row").join(chosen.hint("shuffle_hash"), ["uid", "twin"])
    once, again = whole.where("times = 1"), whole.where("times > 1")
    folded = again.groupBy("uid", "twin").agg(*[F.first(c).alias(c) for c in ("row", "root", "first")])
    return once.select("row", "root", "first").union(folded.select("row", "root", "first"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = simhash_groups(docs)
    return done.select(F.col("row.doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
