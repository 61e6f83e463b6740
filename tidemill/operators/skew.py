"""Joins with a table of one row a key, in which some keys hold a large share of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most its inverse of them.
HOT_SHARE = 1 / 200


def hot_keys(rows: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least a share of the rows: at most 1 / share rows, counted before the exchange."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.agg((F.count("*") * F.lit(share)).alias("_least"))
    return counted.join(F.broadcast(total), F.col("_n") >= F.greatest("_least", F.lit(2))).select(*keys)  # the total is one row


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has at most one row a key.

    Hot keys' rows of the table (at most 1 / HOT_SHARE) are broadcast, so rows of a hot key stay where
    they are; all others meet by an exchange.  ``how``: inner, left, left_semi or left_anti.  Null keys
    meet nothing.
    """
    hot = F.broadcast(hot_keys(rows.where(_none_null(keys)), keys).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, keys, "left")
    few = table.join(F.broadcast(hot), keys, "left_semi")  # one row a hot key
    ours = marked.where("_hot").drop("_hot").join(F.broadcast(few), keys, how)
    others = marked.where("_hot is null").drop("_hot").join(table, keys, how)
    return ours.unionByName(others)


def _none_null(keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out
