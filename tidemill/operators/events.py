"""Event logs: bounded memory, trajectories, forensics, opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import memory_item


def memory(df: DataFrame, by: list[str], order: list[str], item: Column, limit: int) -> DataFrame:
    """``memory``: the last ``limit`` items up to each row, cut to the item limit."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(limit - 1), 0)
    return df.withColumn("memory", F.collect_list(memory_item(item)).over(frame))


def trajectory(df: DataFrame, by: list[str], order: list[str], last: Column, required: bool = False) -> DataFrame:
    """Rows up to and with the first for which ``last`` holds, numbered from 0 as ``step``.

    Groups without such a row vanish, or raise an error if one is required.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(last.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.max(last.cast("int")).over(Window.partitionBy(*by))
    out = df.withColumns({"step": (F.row_number().over(w) - 1), "_before": before, "_ends": whole})
    if required:
        out = out.withColumn("_ends", F.when(F.col("_ends") == 1, 1).otherwise(F.raise_error(F.lit("trajectory has no end")).cast("int")))
    return out.where("_before = 0 and _ends = 1").drop("_before", "_ends")


def remembers(memory: Column, told: Column, in_view: Column | None = None) -> Column:
    """Does a memory hold the text, and, where asked, is anything in view."""
    held = F.exists(memory, lambda item: F.contains(item, told))
    return held if in_view is None else held & in_view


def latest(df: DataFrame, by: list[str], order: str, condition: Column, value: str) -> DataFrame:
    """The value of each group's last row that meets the condition; folds before the exchange."""
    return df.where(condition).groupBy(*by).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def before_each(df: DataFrame, by: list[str], order: list[str], which: Column, values: list[str]) -> DataFrame:
    """For each row that ``which`` marks, the values of the row before it in its group (forensics)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"last_{v}": F.lag(v).over(w) for v in values}).where(which)


def reciprocal(shares: DataFrame, world: list[str], donor: str, target: str) -> DataFrame:
    """Unordered pairs that shared both ways, with how often each way; pairs are counted before they meet."""
    n = shares.groupBy(*world, donor, target).agg(F.count("*").alias("n"))
    back = n.select(*world, F.col(donor).alias(target), F.col(target).alias(donor), F.col("n").alias("n_back"))
    return n.join(back, [*world, donor, target]).where(F.col(donor) < F.col(target))
