"""Ranks over a whole table without a sort in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.cells import partitions, save


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """The rows with ``name``: 1, 2, 3... in an order that must be total, so that ranges can split any tie.

    Rows are range-partitioned and numbered within their task; counts, one row a task, are summed in
    the tasks' order.  The frame is read twice (once for the ranges): pass a saved one.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    schema = T.StructType(list(df.schema.fields)).add("_task", "integer").add("_place", "long")

    def numbered(batches):
        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, task, np.int32)), pa.array(np.arange(at + 1, at + n + 1))], names=[*b.schema.names, "_task", "_place"])
            at += n

    placed = save(dealt.mapInArrow(numbered, schema), "ranks")
    counts = placed.groupBy("_task").agg(F.count("*").alias("n")).orderBy("_task").collect()  # one row a task
    before = np.r_[0, np.cumsum([r.n for r in counts])].tolist()
    bases = spark.createDataFrame([(r["_task"], b) for r, b in zip(counts, before, strict=False)], "_task int, _before long")
    return placed.join(F.broadcast(bases), "_task").withColumn(name, F.col("_before") + F.col("_place")).drop("_task", "_place", "_before")
