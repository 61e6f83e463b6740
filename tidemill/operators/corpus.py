"""Corpus curation: stable deduplication, curation with reasons, top-up, strata, shuffles and splits.

Order is an explicit column.  Seeded choices rank by md5 of seed and key, so they don't depend on how
rows are partitioned and any engine repeats them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def first_occurrence(df: DataFrame, fingerprint: list[str], order: list[str]) -> DataFrame:
    """The first row of each fingerprint.  Found by a minimum, so equal rows fold before the exchange.

    Nulls are values like others, in fingerprints and in orders, where they come first.  ``order`` should be
    total: rows that tie at the first place all stay.
    """
    least = df.groupBy(*fingerprint).agg(F.min(F.struct(*order)).alias("_first"))
    keys, ats = [F.col(c).alias(f"_key{i}") for i, c in enumerate(fingerprint)], [F.col("_first").getField(o).alias(f"_at{i}") for i, o in enumerate(order)]
    first = least.select(*keys, *ats)
    same = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(fingerprint)] + [F.col(o).eqNullSafe(F.col(f"_at{i}")) for i, o in enumerate(order)]
    return df.join(first, same, "left_semi")


def duplicate_counters(df: DataFrame, fingerprint: list[str], by: list[str] | None = None) -> DataFrame:
    counted = df.groupBy(*(by or []), *fingerprint).agg(F.count("*").alias("_n"))
    return counted.groupBy(*(by or [])).agg(F.sum("_n").alias("records"), F.count("*").alias("unique_records"), (F.sum("_n") - F.count("*")).alias("duplicates"))


def curated(df: DataFrame, reasons: list[tuple[str, Column]], fingerprint: list[str], order: list[str]) -> DataFrame:
    """Rows with ``removed_reason``: the first rule that holds, else ``duplicate`` for later copies among the rest, else null."""
    rule = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        rule = F.when(condition, name).otherwise(rule)
    ruled = df.withColumn("_rule", rule)
    first = ruled.where("_rule is null").groupBy(*fingerprint).agg(F.min(F.struct(*order)).alias("_first"))
    joined = ruled.join(first, fingerprint, "left")
    later = F.col("_rule").isNull() & (F.struct(*order) != F.col("_first"))
    return joined.withColumn("removed_reason", F.when(later, "duplicate").otherwise(F.col("_rule"))).drop("_rule", "_first")


def fresh(candidates: DataFrame, known: DataFrame, fingerprint: list[str], order: list[str]) -> DataFrame:
    """Candidates whose fingerprint is not known, first occurrence each."""
    return first_occurrence(candidates.join(known.select(*fingerprint).distinct(), fingerprint, "left_anti"), fingerprint, order)


def top_up(base: DataFrame, candidates: DataFrame, label: str, order: list[str], minimum: int) -> DataFrame:
    """Candidates, in order, that bring each class up to ``minimum``.

    The constant bound on the rank lets Spark cut each class to so many rows before the exchange.
    """
    have = base.groupBy(label).agg(F.count("*").alias("_have"))  # one row for each class
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    first = candidates.withColumn("_rank", rank).where(F.col("_rank") <= minimum)
    return first.join(F.broadcast(have), label, "left").where(F.col("_rank") <= minimum - F.coalesce("_have", F.lit(0))).drop("_rank", "_have")


def top_up_stop(candidates: DataFrame, label: str, episode: str, minimum: int, classes: int) -> DataFrame:
    """The first episode after which every one of so many classes has reached the minimum; null if none."""
    by = candidates.groupBy(label, episode).agg(F.count("*").alias("n"))
    running = by.withColumn("total", F.sum("n").over(Window.partitionBy(label).orderBy(episode)))
    reached = running.where(F.col("total") >= minimum).groupBy(label).agg(F.min(episode).alias("at"))
    return reached.agg(F.when(F.count("*") == classes, F.max("at")).alias("stop_episode"), F.count("*").alias("classes_reached"))


def shortages(df: DataFrame, label: str, domain: list, minimum: int) -> DataFrame:
    """Every class of the domain with fewer rows than the minimum, absent ones included."""
    spark = df.sparkSession
    have = df.groupBy(label).agg(F.count("*").alias("n"))
    all_ = spark.createDataFrame([(d,) for d in domain], [label])
    return F.broadcast(all_).join(have, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < minimum)


def stratified(df: DataFrame, label: str, key: str, per_class: int, seed: int) -> DataFrame:
    """``per_class`` rows of each class by seeded rank."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(seeded(seed, F.col(key)), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= per_class).drop("_rank")


def shuffled(df: DataFrame, key: str, seed: int, limit: int | None = None) -> DataFrame:
    out = df.orderBy(seeded(seed, F.col(key)), key)
    return out if limit is None else out.limit(limit)


def split(df: DataFrame, key: str, seed: int, least: int = 20) -> DataFrame:
    """``part``: the min(0.1 n, 200) rows of least seeded hash are test, the others train.

    The cut is the hash of the last test row, found by a bounded top-k, so no task ranks all rows.
    """
    n = df.count()
    if n < least:
        raise ValueError(f"needs {least} rows, found {n}")
    k = min(n // 10, 200)
    test = df.select(key, seeded(seed, F.col(key)).alias("_h")).orderBy("_h", key).limit(k).select(key, F.lit(True).alias("_test"))
    return df.join(F.broadcast(test), key, "left").withColumn("part", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def union_records(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def contamination(train: DataFrame, held_out: DataFrame, fingerprint: list[str], name: str) -> DataFrame:
    """How many distinct fingerprints of each held-out file are in the training corpus."""
    overlap = held_out.select(name, *fingerprint).distinct().join(train.select(*fingerprint).distinct(), fingerprint, "left_semi")
    return held_out.select(name).distinct().join(overlap.groupBy(name).agg(F.count("*").alias("n")), name, "left").select(name, F.coalesce("n", F.lit(0)).alias("overlap"))


def top_up_counts(base: DataFrame, candidates: DataFrame, added: DataFrame, fingerprint: list[str]) -> DataFrame:
    """One row: records of the base, of the candidates, added, in total, and distinct ones of the base."""
    b = base.agg(F.count("*").alias("base_records"), F.countDistinct(*fingerprint).alias("unique_base_records"))
    one = b.crossJoin(candidates.agg(F.count("*").alias("candidate_records"))).crossJoin(added.agg(F.count("*").alias("added_records")))  # one row each
    return one.withColumn("total_records", F.col("base_records") + F.col("added_records"))


def all_distinct(df: DataFrame, fingerprint: list[str]) -> DataFrame:
    """The corpus as it is; an error where a record repeats."""
    n, distinct = df.agg(F.count("*"), F.countDistinct(*fingerprint)).first()
    if n != distinct:
        raise ValueError(f"base corpus repeats {n - distinct} records")
    return df
