"""Importance resampling towards a target corpus, over bucket-partitioned inverted postings.

Every document's word runs are hashed to buckets.  A bucket's gain is the log ratio of its smoothed
shares in the target and in the documents; a document's weight is the mean gain of its features, and
the documents with the greatest weight plus Gumbel noise are drawn.

Texts are read once.  A task turns some 1 MB of texts (a chunk) into postings (bucket, document,
count), sorted by bucket and packed as one cell per group of buckets, and sums its buckets.  The
postings are shuffled by group of buckets and slice of chunks, so the postings of a bucket that every
document holds are spread over all slices, and meet there the totals of both corpora for the group's
buckets (bounded by the number of buckets).  Gains are computed in that task, and what a chunk's
documents gain in the group leaves it as one cell, which is reduced by document.  The cut of the draw
comes from the counts of each score, of which there are at most some hundred thousand, and only rows
above it are ranked.

Defined results: a null or empty text has no features and weight 0, and is never drawn; a null id
hashes as an empty one and comes last among ties; rows of one id share their noise; equal rows are
rows of their own and take ranks of their own; a long text counts whole, as a chunk of its own; empty
documents give an empty table; with an empty target, or empty documents, the smoothing alone decides;
input columns travel in the struct ``row`` and cannot clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.cells import save
from tidemill.llm.ranks import ranked
from tidemill.llm.textvec import row_chunks, text_buffer

BUCKETS, RUN, LEAST_FEATURES, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Groups of buckets, and bytes of text whose postings meet in one task of a group.
GROUPS, SLICE_BYTES, CHUNK = 16, 1 << 25, 1 << 20
#: Word bytes: digits, lower-case letters, and all bytes of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
POSTING, TOTAL, DOCUMENT = 0, 1, 2
#: Beyond so many bytes a word is hashed by itself.
SHORT = 48


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def crc32(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of every range, one step for each place within the ranges."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    for at in range(min(int(size.max(initial=0)), SHORT)):
        on = order[: np.searchsorted(falling, -at, "left")]
        out[on] = CRC[(out[on] ^ buf[start[on] + at]) & 0xFF] ^ (out[on] >> 8)
    out = ~out
    raw = memoryview(np.ascontiguousarray(buf))
    for i in order[: np.searchsorted(falling, -SHORT, "left")].tolist():
        out[i] = zlib.crc32(raw[start[i] : end[i]])
    return out


def features(buf: np.ndarray, offs: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every feature of many texts, and the text of each: all runs of 1 to ``run`` words joined by one space."""
    low = LOWER[buf]
    word = WORD[low]
    first, last = word.copy(), word.copy()
    if len(buf):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = np.flatnonzero(offs[1:] > offs[:-1])
        first[offs[full]] = word[offs[full]]
        last[offs[full + 1] - 1] = word[offs[full + 1] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offs, start, "right") - 1
    out, docs = [crc32(low, start, end)], [doc]
    if run > 1 and len(start):
        # the words alone, one space behind each
        size = end - start + 1
        to = np.r_[0, np.cumsum(size)]
        packed = np.full(to[-1], 0x20, np.uint8)
        inside = np.repeat(start - to[:-1], size) + np.arange(to[-1])
        letter = np.ones(to[-1], bool)
        letter[to[1:] - 1] = False
        packed[letter] = low[inside[letter]]
        for n in range(2, run + 1):
            at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
            out.append(crc32(packed, to[at], to[at + n] - 1))
            docs.append(doc[at])
    return np.concatenate(out), np.concatenate(docs)


def _cell(*columns: np.ndarray) -> bytes:
    """Columns one behind the other, so that the exchange's compression meets like values."""
    return b"".join(c.tobytes() for c in columns)


def _uncell(cell, kinds: tuple) -> list[np.ndarray]:
    raw = cell.as_buffer()
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


NAMES = ["kind", "part", "chunk", "at", "cell", "n_features", "row"]
TRIPLE, CELL = ("<u4", "<u4", "<u4"), "kind int, part int, chunk long, at int, cell binary, n_features long"


def postings(docs: DataFrame, text_col: str, buckets: int, run: int, groups: int, with_rows: bool = True) -> DataFrame:
    """Cells of postings (kind 0; ``part`` is the group), sums by bucket (kind 1, one row a task) and the documents themselves (kind 2; ``row``).

    Everything comes from one saved table, so a chunk's number means the same in all three.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    kept = F.struct(*others) if with_rows and others else F.lit(None).cast("struct<none:int>")
    rows = docs.select(kept.alias("row"), F.col(text_col).cast("string").alias("text"))
    row_type = rows.schema["row"].dataType
    schema = T.StructType.fromDDL(CELL).add("row", row_type)

    def run_task(batches):
        chunk = TaskContext.get().partitionId() << 32
        total = np.zeros(buckets, np.int64)
        kind_of = None

        def cells(kind, part, chunk, at, cell, n, row):
            m = len(kind)
            columns = [pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(m, chunk)), pa.array(at, pa.int32()), pa.array(cell, pa.binary()), pa.array(n, pa.int64()), row]
            return pa.RecordBatch.from_arrays(columns, names=NAMES)

        for t in row_chunks(batches, CHUNK):
            kind_of = t.schema.field("row").type
            buf, offs = text_buffer(t.column("text"))
            crc, doc = features(buf, offs, run)
            n = np.bincount(doc, minlength=t.num_rows)
            key, count = np.unique(crc.astype(np.int64) % buckets * t.num_rows + doc, return_counts=True)
            bucket, at = key // t.num_rows, key % t.num_rows
            total += np.bincount(bucket, count, buckets).astype(np.int64)
            if with_rows:
                cut = np.searchsorted(bucket * groups // buckets, np.arange(groups + 1))
                parts = [g for g in range(groups) if cut[g + 1] > cut[g]]
                made = [_cell(*(x[cut[g] : cut[g + 1]].astype("<u4") for x in (bucket, at, count))) for g in parts]
                yield cells([POSTING] * len(parts), parts, chunk, [0] * len(parts), made, [None] * len(parts), pa.nulls(len(parts), kind_of))
                row = t.column("row").combine_chunks()
                yield cells([DOCUMENT] * t.num_rows, [None] * t.num_rows, chunk, np.arange(t.num_rows), [None] * t.num_rows, n, row if isinstance(row, pa.Array) else row.chunk(0))
            chunk += 1
        if kind_of is not None:
            held = np.flatnonzero(total)
            yield cells([TOTAL], [None], chunk, [0], [_cell(held.astype("<u4"), total[held].astype("<i8"))], [None], pa.nulls(1, kind_of))

    return rows.mapInArrow(run_task, schema)


def bucket_sums(cells: DataFrame, name: str) -> DataFrame:
    """bucket and its features in a corpus: one row a bucket at most."""

    def run(batches):
        for b in batches:
            for cell in b.column("cell"):
                bucket, n = _uncell(cell, ("<u4", "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n)], names=["bucket", "n"])

    return cells.where(F.col("kind") == TOTAL).select("cell").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def noise(seed: int, key: Column) -> Column:
    """Gumbel noise in thousandths, from sha256 of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighted(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, run: int = RUN, groups: int = GROUPS) -> DataFrame:
    """Each input row as ``row`` (without its text) with chunk and at (its place), n_features and weight."""
    spark = docs.sparkSession
    cells = save(postings(docs, text_col, buckets, run, groups), "postings")
    texts = target.select(F.col(target_col).alias("text"))
    ours, theirs = bucket_sums(cells, "s"), bucket_sums(postings(texts, "text", buckets, run, groups, with_rows=False), "t")
    # one row a bucket, whatever the corpora
    sums = save(ours.join(theirs, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "bucket-sums")
    s_all, t_all = (x or 0 for x in sums.agg(F.sum("s"), F.sum("t")).first())
    chunks = -(-cells.where(F.col("kind") == POSTING).count() // groups)
    slices = max(1, -(-chunks * CHUNK // SLICE_BYTES))
    slice_of = F.pmod(F.xxhash64("chunk"), F.lit(slices)).cast("int")
    left = cells.where(F.col("kind") == POSTING).select("part", slice_of.alias("slice"), "chunk", "cell")
    group = F.expr(f"cast(cast(bucket as bigint) * {groups} div {buckets} as int)")
    by_group = sums.select(group.alias("part"), "bucket", "s", "t").groupBy("part").agg(F.collect_list(F.struct("bucket", "s", "t")).alias("sums"))  # the buckets of a group
    right = by_group.select("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "sums")

    def gained(postings: pa.Table, sums: pa.Table) -> pa.Table:
        chunks, out = [], []
        if postings.num_rows:
            known = sums.column("sums").combine_chunks().flatten()
            bucket, s, t = (known.field(k).to_numpy(zero_copy_only=False) for k in ("bucket", "s", "t"))
            ratio = (t + 1.0) * float(s_all + buckets) / ((s + 1.0) * float(t_all + buckets))
            low = int(bucket.min())
            gain = np.zeros(int(bucket.max()) - low + 1, np.int64)
            gain[bucket - low] = np.floor(1000 * np.log(ratio)).astype(np.int64)
            for chunk, cell in zip(postings.column("chunk").to_pylist(), (c for part in postings.column("cell").chunks for c in part), strict=True):
                b, at, n = _uncell(cell, TRIPLE)
                order = np.argsort(at, kind="stable")
                at, value = at[order], (gain[b.astype(np.int64) - low] * n)[order]
                lead = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                chunks.append(chunk)
                out.append(_cell(at[lead], np.add.reduceat(value, lead).astype("<i8")))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "cell": pa.array(out, pa.binary())})

    gains = left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(gained, "chunk long, cell binary")
    rows = cells.where(F.col("kind") == DOCUMENT).select("chunk", "at", "n_features", "row")

    def reduced(rows: pa.Table, gains: pa.Table) -> pa.Table:
        at = rows.column("at").to_numpy()
        total = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
        for part in gains.column("cell").chunks:
            for cell in part:
                place, value = _uncell(cell, ("<u4", "<i8"))
                total[place] += value
        n = rows.column("n_features").to_numpy()
        return rows.append_column("weight", pa.array(np.where(n > 0, total[at] // np.maximum(n, 1), 0)))

    schema = T.StructType(list(rows.schema.fields)).add("weight", "long")
    return rows.groupBy("chunk").cogroup(gains.groupBy("chunk")).applyInArrow(reduced, schema)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    target_col: str = "text",
    percent: int = PERCENT,
    least: int = LEAST_FEATURES,
    seed: int = SEED,
    buckets: int = BUCKETS,
    run: int = RUN,
    groups: int = GROUPS,
) -> DataFrame:
    """Each input row as ``row`` (without its text) with n_features, weight, score and rank (null where it was not drawn).

    Drawn are ``percent`` of the rows with at least ``least`` words, from the greatest score, ties to the smaller id.
    """
    done = weighted(docs, target, text_col, target_col, buckets, run, groups)
    id_ = F.col(f"row.`{id_col}`")
    scored = save(done.select("row", "chunk", "at", "n_features", "weight", (F.col("weight") + noise(seed, id_)).alias("score")), "scores")
    fit = F.col("n_features") >= sum(max(0, least - i) for i in range(run))  # so many runs has a text of ``least`` words
    by_score = scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()  # scores lie within some hundred thousand values
    k = sum(r.n for r in by_score) * percent // 100
    cut, seen = None, 0
    for r in by_score:
        if seen >= k:
            break
        cut, seen = r.score, seen + r.n
    columns = ["row", "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    above = fit & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("_id"), "chunk", "at"]
    drawn = ranked(scored.where(above).withColumn("_id", id_), order)
    rest = scored.where(~above).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank")).union(rest)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = resampled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"
_H = f"CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)"

#: CRC-32 of each distinct word, bit by bit.
OP11_SQL = f"""
WITH w AS (SELECT 'd' AS side, doc_id, {_WORDS} AS word FROM documents UNION ALL SELECT 't', item_id, {_WORDS} FROM benchmark),
n AS (SELECT side, doc_id, word, count(*) AS n FROM w GROUP BY ALL),
x AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM n)),
b AS (SELECT word, xor(list_reduce(list_transform(range(1, length(x) + 1, 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)),
  lambda c, y: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, y)),
  4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM x),
s AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS t FROM n JOIN b USING (word) GROUP BY 1),
a AS (SELECT CAST(sum(s) + {BUCKETS} AS DOUBLE) AS ours, CAST(sum(t) + {BUCKETS} AS DOUBLE) AS theirs FROM s),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ours / (CAST(s + 1 AS DOUBLE) * theirs))) AS BIGINT) AS gain FROM s, a),
d AS (SELECT doc_id, sum(n) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM n JOIN b USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY 1),
r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(total // n_features - CASE WHEN total % n_features < 0 THEN 1 ELSE 0 END, 0) AS weight,
  CAST(floor(-1000 * ln(-ln(({_H} + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM documents LEFT JOIN d USING (doc_id)),
o AS (SELECT *, weight + noise AS score, n_features >= {LEAST_FEATURES} AS fit FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, {PERCENT} * count(*) FILTER (WHERE fit) OVER () // 100 AS k FROM o)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN fit AND place <= k THEN place END AS rank FROM p"""
