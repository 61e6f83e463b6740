"""Corpus audits: label consistency, neutral identities, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: beginnings of ids and lineages that give a role away.
ROLE_SHAPED = r"^(organism|lineage)-[sr]"


def role_shaped(names: Column) -> Column:
    return F.coalesce(F.exists(names, lambda s: s.rlike(ROLE_SHAPED)), F.lit(False))


def reachable(energy: Column, distance: Column, on_food: Column | None = None) -> Column:
    """Food at a distance needs more energy than steps, unless one stands on food."""
    far = energy > distance
    return far if on_food is None else on_food | far


def label_errors(annotated: Column, truth: Column) -> Column:
    return F.coalesce(annotated != truth, F.lit(True))


def counters(df: DataFrame, by: list[str], checks: dict[str, Column], fingerprint: list[str]) -> DataFrame:
    """Records, distinct records, duplicates and how many rows fail each check, by dataset."""
    parts = df.groupBy(*by, *fingerprint).agg(F.count("*").alias("_n"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    return parts.groupBy(*by).agg(F.sum("_n").alias("records"), F.count("*").alias("unique_records"), (F.sum("_n") - F.count("*")).alias("duplicates"), *[F.sum(k).alias(k) for k in checks])


def verdict(counted: DataFrame, checks: list[str], overlaps: DataFrame | None = None) -> DataFrame:
    """One row: whether all counters of all datasets, and all overlaps, are zero."""
    clean = F.lit(True)
    for c in checks:
        clean = clean & (F.col(c) == 0)
    out = counted.agg(F.count("*").alias("datasets"), F.bool_and(clean).alias("passed"))
    if overlaps is None:
        return out
    none = overlaps.agg(F.coalesce(F.bool_and(F.col("overlap") == 0), F.lit(True)).alias("_none"))
    return out.crossJoin(F.broadcast(none)).select("datasets", (F.col("passed") & F.col("_none")).alias("passed"))  # one row each
