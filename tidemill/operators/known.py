"""A kept index of accepted fingerprints: a bucketed table beside a Bloom filter.

Fingerprints lie in files by bucket, so a candidate set joins them without moving the kept side; and most
candidates do not even join, since the filter (a bit table of fixed size, one row) says that they are
new.  The filter has no false negative; where it says "maybe", the join decides, so results are exact
whatever its size.  Additions append files and OR their bits into the filter.

The index lives in a folder and can be opened again by another session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.corpus import first_occurrence

BITS, HASHES, BUCKETS = 23, 4, 16


def positions(fp: Column, bits: int = BITS, hashes: int = HASHES) -> Column:
    """The bits that a fingerprint sets: steps of one hash from another, in a table of 2**bits."""
    low = F.lit((1 << 40) - 1)  # sums of steps stay far below 63 bits
    a, b = F.xxhash64(fp).bitwiseAND(low), F.xxhash64(F.lit(1), fp).bitwiseAND(low).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (a + i * b).bitwiseAND(F.lit((1 << bits) - 1)))


def _table(at: DataFrame, bits: int) -> DataFrame:
    """One row, ``words``: a table of 2**bits bits as longs, with the bits ``at`` set."""
    word = F.shiftright("at", 6).cast("int").alias("word")
    full = at.select(word, F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    every = at.sparkSession.range(1 << bits - 6).select(F.col("id").cast("int").alias("word"))
    rows = every.join(full, "word", "left").select(F.struct("word", F.coalesce("bit", F.lit(0)).alias("bit")).alias("w"))
    return rows.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bit"]).alias("words"))  # of fixed size


def _is_set(at: Column, words: Column) -> Column:
    return F.call_function("getbit", F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def bloom(fps: DataFrame, fp: str, bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """One row, ``words``: the filter as longs.  Null fingerprints set nothing."""
    return _table(fps.where(F.col(fp).isNotNull()).select(F.explode(positions(F.col(fp), bits, hashes)).alias("at")), bits)


def marks(hashes: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """As ``bloom``, for keys that are 64-bit hashes already: one bit each, which is cheaper to ask for."""
    return _table(hashes.where(F.col(key).isNotNull()).select(F.col(key).bitwiseAND(F.lit((1 << bits) - 1)).alias("at")), bits)


def marked(key: Column, words: Column, bits: int = BITS) -> Column:
    """False where a hash is surely not among the marks."""
    return _is_set(key.bitwiseAND(F.lit((1 << bits) - 1)), words)


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """The filter of what either holds; both of one size."""
    both = one.crossJoin(F.broadcast(other.withColumnRenamed("words", "_other")))  # one row each
    return both.select(F.zip_with("words", "_other", lambda a, b: a.bitwiseOR(b)).alias("words"))


def maybe(fp: Column, words: Column, bits: int = BITS, hashes: int = HASHES) -> Column:
    """False where a fingerprint is surely not in the filter."""
    return F.forall(positions(fp, bits, hashes), lambda at: _is_set(at, words))


class KnownFingerprints:
    """The index in a folder.  ``bits`` and ``buckets`` hold for its life."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", bits: int = BITS, buckets: int = BUCKETS):
        self.spark, self.path, self.bits, self.buckets = spark, path.rstrip("/"), bits, buckets
        self.table = f"known_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (fp {kind}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {buckets} BUCKETS LOCATION '{self.path}/fingerprints'")

    def _filters(self) -> DataFrame:
        return self.spark.read.schema("words array<bigint>").parquet(f"{self.path}/bloom")

    def add(self, rows: DataFrame, fp: str) -> None:
        """Add fingerprints; repeated ones do no harm.  A filter is written for each addition, and they are one when read."""
        new = rows.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
        new.write.format("parquet").mode("append").insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        bloom(new, "fp", self.bits).write.mode("append").parquet(f"{self.path}/bloom")

    def filter(self) -> DataFrame:
        """One row, ``words``: all additions together."""
        places = self._filters().select(F.posexplode("words").alias("at", "bit")).groupBy("at").agg(F.bit_or("bit").alias("bit"))  # of fixed size for each addition
        return places.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bit"))), lambda w: w["bit"]).alias("words"))

    def split(self, candidates: DataFrame, fp: str) -> tuple[DataFrame, DataFrame]:
        """Candidates that are surely new, and those that the filter cannot tell.  A null fingerprint is new."""
        seen = candidates.crossJoin(F.broadcast(self.filter()))  # one row
        hit = F.coalesce(maybe(F.col(fp), F.col("words"), self.bits), F.lit(False))
        return seen.where(~hit).drop("words"), seen.where(hit).drop("words")

    def unknown(self, candidates: DataFrame, fp: str) -> DataFrame:
        """Candidates whose fingerprint is not in the index; the kept side is not moved."""
        new, open_ = self.split(candidates, fp)
        kept = self.spark.table(self.table).withColumnRenamed("fp", fp).hint("merge")
        return new.unionByName(open_.join(kept, fp, "left_anti"))

    def fresh(self, candidates: DataFrame, fp: str, order: list[str]) -> DataFrame:
        """Unknown candidates, first occurrence each."""
        return first_occurrence(self.unknown(candidates, fp), [fp], order)

    def close(self) -> None:
        """Forget the table's name; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
