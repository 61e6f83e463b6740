"""Ancestry of any depth by pointer doubling.

Each row points at an ancestor and knows how many generations lie between; a round replaces the
pointer by that of the ancestor, which doubles its reach.  So a line of a million generations takes
twenty rounds, each one join, where a recursive query takes a million.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.skew import lookup
from tidemill.sources.staging import staged


def ancestry(parents: DataFrame, cycles: bool = False) -> DataFrame:
    """``id``, ``root`` and ``depth`` from (id, parent): parent null for a root.

    Rows below an unknown parent have no root and are left out.  Rows in or below a cycle are left out
    too, or, with ``cycles``, come with root and depth null.  An id listed twice counts by its least
    parent, null first; null ids are left out.
    """
    known = parents.where(F.col("id").isNotNull()).groupBy("id").agg(F.bool_or(F.col("parent").isNull()).alias("top"), F.min("parent").alias("parent"))
    at = F.when(F.col("top"), F.col("id")).otherwise(F.col("parent"))
    base = staged(known.select("id", at.alias("at"), (~F.col("top")).cast("long").alias("depth"), F.col("top").alias("done")), "lineage")
    named = lambda rows: rows.where("done").select("id", F.col("at").alias("root"), "depth")
    finished, left, state = [named(base)], base.where("not done").drop("done"), base
    while True:
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("_to"), F.col("depth").alias("_more"), F.col("done").alias("_done"))
        moved = staged(lookup(left, ahead, ["at"]).select("id", F.col("_to").alias("at"), (F.col("depth") + F.col("_more")).alias("depth"), F.col("_done").alias("done")), "lineage")
        left = moved.where("not done").drop("done")
        if moved.where("done").isEmpty():
            break  # every line that ends in a root gains one in each round
        finished.append(named(moved))
        # rows that are done answer for themselves; those still open answer with their new reach
        now = [f.select("id", F.col("root").alias("at"), "depth", F.lit(True).alias("done")) for f in finished]
        state = reduce(DataFrame.union, [*now, left.select("id", "at", "depth", F.lit(False).alias("done"))])
    out = reduce(DataFrame.union, finished)
    return out.unionByName(left.select("id", F.lit(None).cast(out.schema["root"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"))) if cycles else out
