from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        if number == len(corpus_pipeline.STAGES) - 1:
            assert made.count() >= docs.count()
            return
        assert made.columns == columns and dict(made.dtypes) == dict(docs.dtypes)
        docs = made.cache()
        assert 0 < docs.count() <= before
        before = docs.count()


def test_edge_documents(spark, edge_docs):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage, each on its own."""
    docs = edge_docs.withColumns({c: F.lit(c) for c in ("first", "root", "_uid", "uid", "shard", "task", "rank", "kept_text", "digest")})
    n = docs.count()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, "/root/testdata/sf0.01")
        if number == len(corpus_pipeline.STAGES) - 1:
            assert made.select("sequence_id", "offset").distinct().count() == made.count() >= n
            continue
        assert made.columns == docs.columns and made.count() <= n, name
        if name == "SimHash near-dedup":
            kept = Counter(r.text for r in made.collect())
            assert max(kept.values()) == 1  # one of equal texts
        if name == "suffix-array dedup":
            assert made.where("doc_id = 11").first() is None  # a repeated row repeats wholly
            assert made.where("doc_id = 3 and text = 'one'").count() == 1  # too short to lose anything


def test_run_equals_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
    whole = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"))
    alone = corpus_pipeline.STAGES[-1][1](spark, docs, sf).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, alone.collect()))


def test_empty(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
