"""Scoring of predictions: rollups, confusion, recall, macro accuracy, cases and pairs."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemill.functions.rates import rate, share_of


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def eval_rollup(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: records, and for each flag its count and its share of all records."""
    out = [F.count("*").alias("records")]
    for name, flag in flags.items():
        out += [F.count_if(flag).alias(f"n_{name}"), share_of(flag).alias(f"{name}_rate")]
    return df.agg(*out)


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Counts of (expected, predicted); rows without a prediction don't count."""
    return df.where(F.col(predicted).isNotNull()).groupBy(expected, predicted).agg(F.count("*").alias("n"))


def recall(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Records, hits and recall by class; rows without a prediction count as missed."""
    hit = F.coalesce(F.col(expected) == F.col(predicted), F.lit(False))
    return df.groupBy(expected).agg(F.count("*").alias("records"), F.count_if(hit).alias("hits"), share_of(hit).alias("recall"))


def macro_accuracy(recalls: DataFrame) -> DataFrame:
    """Mean of the rounded recalls of all classes present, rounded again."""
    return recalls.agg(F.count("*").alias("classes"), F.coalesce(F.bround(F.avg("recall"), 4), F.lit(0.0)).alias("macro_accuracy"))


def case_rates(df: DataFrame, case: str, flags: dict[str, Column]) -> DataFrame:
    out = [F.count("*").alias("records")]
    for name, flag in flags.items():
        out += [F.count_if(flag).alias(name), share_of(flag).alias(f"{name}_rate")]
    return df.groupBy(case).agg(*out)


def pair_exact(df: DataFrame, pair: list[str], exact: Column) -> DataFrame:
    """Groups of exactly two, how many are right in both members, and their share."""
    groups = df.groupBy(*pair).agg(F.count("*").alias("n"), F.bool_and(exact).alias("both")).where("n = 2")
    return groups.agg(F.count("*").alias("complete_pairs"), F.count_if("both").alias("exact_pairs"), rate(F.count_if("both"), F.count("*")).alias("pair_exact_accuracy"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Verdict of each (metric, comparator, threshold) on (metric, value), and of all together; a missing metric fails."""
    value, limit = F.col("value"), F.col("threshold")
    by = {">=": value >= limit, "<=": value <= limit, ">": value > limit, "<": value < limit}
    passed = F.when(F.col("comparator").isin(*by), F.lit(False)).otherwise(value == limit)
    for sign, holds in by.items():
        passed = F.when(F.col("comparator") == sign, holds).otherwise(passed)
    judged = thresholds.join(metrics, "metric", "left").withColumn("passed", F.coalesce(passed, F.lit(False)))
    verdict = judged.agg(F.bool_and("passed").alias("all_passed"))
    return judged.crossJoin(F.broadcast(verdict))  # the verdict is one row


def class_deltas(ours: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """Difference of a value by class in percentage points, over all classes of either side."""
    joined = ours.select(key, F.col(value).alias("a")).join(base.select(key, F.col(value).alias("b")), key, "full")
    return joined.select(key, F.bround((F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))) * 100, 2).alias("delta_points"))


def throughput(df: DataFrame, path: str | None = None) -> tuple[int, float, float | None]:
    """Records, seconds, and records a second (none in no time) of writing a table, counted in the same job; without a path nothing is kept."""
    seen = Observation()
    out = df.observe(seen, F.count("*").alias("n")).write.mode("overwrite")
    began = time.monotonic()
    out.parquet(path) if path else out.format("noop").save()
    seconds = time.monotonic() - began
    n = seen.get["n"]
    return n, seconds, round(n / seconds, 3) if seconds else None
