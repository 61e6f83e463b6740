"""Passages inside documents, without comparing every pair.

A passage is found by a run of its inner words (whole words, whatever stands around it): six of them, or
all where it has fewer; a passage of one or two words by its first characters, four at most.  Every run
of a document is asked for in a bit table of the passages' keys (of fixed size, one row) while it is still
part of its row, so only the few runs that may be one leave it.  They meet the passages by key, and
the texts are compared.  One pass over the documents; their texts are not joined again.

Defined results: an empty passage is inside every text; null texts and null passages meet nothing; a
passage may overlap itself and counts once for a document; repeated rows count each for themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.known import BITS, marked, marks

RUN, CHARS = 6, 4


def _key(kind: str, run: Column) -> Column:
    return F.xxhash64(F.lit(kind), run)


def _hashed(text: Column) -> Column:
    """A hash of each word."""
    return F.transform(F.split(text, " "), lambda w: F.xxhash64(w))


def _runs(hashes: Column, n: int) -> Column:
    """Keys of all runs of n words, from the words' hashes."""
    each = F.transform(F.sequence(F.lit(1), F.size(hashes) - n + 1), lambda i: _key(f"w{n}", F.slice(hashes, i, n)))
    return F.when(F.size(hashes) >= n, each).otherwise(F.array().cast("array<bigint>"))


def _starts(text: Column, n: int) -> Column:
    """Keys of all runs of n characters."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: _key(f"c{n}", F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, each).otherwise(F.array().cast("array<bigint>"))


def keyed(passages: DataFrame, item: str, text: str) -> DataFrame:
    """item, passage, the kind of its key (w6, w1 to w5, c1 to c4) and its key; empty passages have none."""
    p = passages.where(F.length(text) > 0).select(F.col(item).alias("item"), F.col(text).alias("passage")).withColumn("w", _hashed(F.col("passage")))
    inner, chars = F.least(F.size("w") - 2, F.lit(RUN)), F.least(F.length("passage"), F.lit(CHARS))
    by_words = F.size("w") > 2
    kind = F.when(by_words, F.concat(F.lit("w"), inner.cast("string"))).otherwise(F.concat(F.lit("c"), chars.cast("string")))
    key = F.when(by_words, F.xxhash64(kind, F.slice("w", F.lit(2), F.greatest(inner, F.lit(0))))).otherwise(F.xxhash64(kind, F.substring("passage", F.lit(1), chars)))
    return p.select("item", "passage", kind.alias("kind"), key.alias("key"))


def passages_within(documents: DataFrame, passages: DataFrame, doc: str, item: str, text: str = "text", bits: int = BITS) -> DataFrame:
    """``doc`` and ``item`` for every passage (``text``) that a document (``text``) contains."""
    keys = keyed(passages, item, text)
    kinds = sorted(r.kind for r in keys.select("kind").distinct().collect())  # ten at most
    d = documents.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    empty = passages.where(F.length(text) == 0).select(F.col(item).alias("item"))
    everywhere = d.select("doc").join(empty, F.lit(True)) if not empty.isEmpty() else d.select("doc", F.lit(None).alias("item")).limit(0)
    if not kinds:
        return everywhere.select(F.col("doc").alias(doc), F.col("item").alias(item))
    d = d.withColumn("w", _hashed(F.col("text")))
    every = F.concat(*[_runs(F.col("w"), int(k[1:])) if k[0] == "w" else _starts(F.col("text"), int(k[1:])) for k in kinds])
    asked = d.crossJoin(F.broadcast(marks(keys, "key", bits)))  # one row
    some = asked.select("doc", "text", F.array_distinct(F.filter(every, lambda k: marked(k, F.col("words"), bits))).alias("keys"))
    met = some.where(F.size("keys") > 0).select("doc", "text", F.explode("keys").alias("key")).join(keys.select("item", "passage", "key"), "key")
    found = met.where(F.contains("text", "passage")).select("doc", "item")
    return found.unionByName(everywhere.select("doc", F.col("item").cast(found.schema["item"].dataType).alias("item"))).select(F.col("doc").alias(doc), F.col("item").alias(item))
