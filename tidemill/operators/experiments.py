"""Paired experiments: per-condition rollups, paired effects, scene consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.rates import rate


def condition_rollup(df: DataFrame, condition: str, ratios: dict[str, tuple[Column, Column]], means: dict[str, Column]) -> DataFrame:
    """By condition: rows, ratios of sums, and means, rounded as in the reports."""
    out = [F.count("*").alias("runs")]
    out += [rate(F.sum(a), F.sum(b)).alias(k) for k, (a, b) in ratios.items()]
    out += [F.coalesce(F.bround(F.avg(v), 3), F.lit(0.0)).alias(k) for k, v in means.items()]
    return df.groupBy(condition).agg(*out)


def paired_effects(runs: DataFrame, unit: list[str], condition: str, treated, control, effects: dict[str, tuple[str, int]]) -> DataFrame:
    """Mean over complete pairs of treated - control (sign 1) or control - treated (sign -1) of each value."""
    at = lambda value, which: F.max(F.when(F.col(condition) == which, F.col(value)))
    both = runs.where(F.col(condition).isin(treated, control)).groupBy(*unit).agg(
        F.count_distinct(condition).alias("_k"), *[((at(v, treated) - at(v, control)) * sign).alias(k) for k, (v, sign) in effects.items()]
    )
    return both.where("_k = 2").agg(F.count("*").alias("pairs"), *[F.sum(k).alias(f"{k}_sum") for k in effects], *[F.coalesce(F.bround(F.avg(k), 4), F.lit(0.0)).alias(k) for k in effects])


def scene_consistency(df: DataFrame, unit: list[str], scene: Column) -> DataFrame:
    """Units whose conditions don't all share one scene."""
    return df.groupBy(*unit).agg(F.count_distinct(scene).alias("scenes")).where("scenes <> 1")


def duplicate_seeds(df: DataFrame, seed: str) -> DataFrame:
    return df.groupBy(seed).agg(F.count("*").alias("n")).where("n > 1")


def first_tick(tick: Column, condition: Column) -> Column:
    return F.min(F.when(condition, tick))
