"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.cells import discard, save


#: Edge tables of more rows are joined by a merge: files tell little of the memory that a broadcast of them takes.
FEW = 100_000


def spanning(n: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Edges of ``pairs`` (an iterable of two index arrays) that still join different groups of n items."""
    root = np.arange(n)
    left, right = [], []
    for a, b in pairs:
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        while len(a):
            lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            # one edge for each group that is hung below another, so that edges stay fewer than items
            best = np.lexsort((lo, hi))
            first = best[np.r_[True, hi[best][1:] != hi[best][:-1]]]
            left.append(a[first])
            right.append(b[first])
            root[hi[first]] = lo[first]
            while not np.array_equal(up := root[root], root):
                root = up
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and its ``root`` (the least node it reaches) for every node of the edges (a, b); no edges, no rows.

    Each round is two aggregations and joins by node; rounds grow with the logarithm of the longest
    path.  The edge table is written to the shared folder after each, so that lineage stays short.
    """
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    before = e.select(mark.alias("m")).first().m
    while before.n:
        held = (lambda df: df.hint("merge")) if before.n > FEW else (lambda df: df)
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(held(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(held(least), "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        older, e = e, save(small, "edges")
        discard(e.sparkSession, older.saved_at)
        now = e.select(mark.alias("m")).first().m
        if now == before:
            break
        before = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
