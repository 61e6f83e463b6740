"""Sharding along a Hilbert curve over metadata.

Language, source and size are quantised to a cube of BITS bits a side; documents are sorted by the
cube's index on the Hilbert curve and cut into runs.  Neighbours on the curve are neighbours in all
dimensions, so a filter on any of them skips most files of a shard by their column statistics.

The law is ``rows``: shards' counts differ by one at most.  That needs every document's rank, found
without a global sort in one task: the metadata is range-partitioned by (curve, id, checksum, tie),
which is unique and so splits any hot cell, each partition numbers its rows, and partition counts
(one row per partition) are summed in order.

Defined results: null text counts as empty (size 1, checksum 0); null language or source is a value
of its own; null ids come first within a cell; a long text counts by its size only; ties and repeated
rows take slots of their own; an empty table gives an empty one; input columns travel in ``row`` and
cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.cells import partitions, save

SHARDS, BITS = 16, 5


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points (n, d) with coordinates below 2**bits (Skilling's transform)."""
    x = axes.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            on = (x[:, d] & q) > 0
            x[on, 0] ^= low
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= swap
            x[:, d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, -1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | (x[:, d] >> b & 1)
    return out


@F.pandas_udf(T.LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert(np.stack([a, b, c], axis=1), BITS))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("lang", "source"), whole: bool = False) -> DataFrame:
    """Each input row as ``row`` (without its text, unless ``whole``) with size, text_crc32, curve, shard and slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    side = 1 << BITS
    cell = [F.when(F.col(d).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(d).cast("string")), F.lit(side - 1))).cast("int") for d in dims]
    step = F.least(F.lit(side - 1), F.floor(F.log2(size) * 1.5)).cast("int")
    others = [F.col(f"`{c}`") for c in docs.columns if whole or c != text_col]
    meta = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _curve(*cell, step).alias("curve"), F.monotonically_increasing_id().alias("tie"))
    key = ["curve", "id", "text_crc32", "tie"]
    dealt = save(meta, "shard-meta").repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key)
    schema = T.StructType([meta.schema["row"]]).add("size", "long").add("text_crc32", "long").add("curve", "long").add("task", "integer").add("place", "long")

    def numbered(batches):
        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("size"), b.column("text_crc32"), b.column("curve"), pa.array(np.full(n, task, np.int32)), pa.array(np.arange(at, at + n))], ["row", "size", "text_crc32", "curve", "task", "place"])
            at += n

    placed = save(dealt.mapInArrow(numbered, schema), "shard-places")
    counts = placed.groupBy("task").agg(F.count("*").alias("n")).orderBy("task").collect()  # one row per partition
    total = sum(r.n for r in counts)
    before = dict(zip((r.task for r in counts), np.r_[0, np.cumsum([r.n for r in counts])].tolist(), strict=False))
    bases = spark.createDataFrame(list(before.items()), "task int, before long")
    ranked = placed.join(F.broadcast(bases), "task").withColumn("rank", F.col("before") + F.col("place"))
    shard = F.expr(f"cast((rank * {shards}) div {max(total, 1)} as int)")
    first = F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select("row", "size", "text_crc32", "curve", "shard", (F.col("rank") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, str] = ("lang", "source")) -> str:
    """Documents as Parquet, one folder per shard, in slot order, so that files have narrow column ranges; returns the name of the folders' column.

    Rows are dealt by ranges of (shard, slot) to as many tasks as the session has partitions, so a shard
    has many files.  The column is ``shard``, with underscores behind it where the documents have that name.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    placed = hilbert_shards(docs, shards, id_col, text_col, dims, whole=True)
    dealt = placed.repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    done = hilbert_shards(docs)
    return done.select(F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
