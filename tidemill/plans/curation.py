"""Corpus curation queries on documents and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemill.operators import audit as U
from tidemill.operators import corpus as C
from tidemill.operators.acceptance import accept_groups
from tidemill.operators.known import KnownFingerprints
from tidemill.operators.passages import passages_within
from tidemill.plans.registry import query
from tidemill.sources.staging import shared_folder

_FIRST = "SELECT doc_id, sha256(text) AS fp, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents"


def fingerprinted(tables):
    return tables("documents").withColumn("fp", F.sha2("text", 256))


@query(f"SELECT doc_id, fp FROM ({_FIRST}) WHERE r = 1")
def fingerprint_dedupe(spark, tables):
    return C.first_occurrence(fingerprinted(tables).select("doc_id", "fp"), ["fp"], ["doc_id"])


@query("SELECT lang, count(*) AS records, count(DISTINCT text) AS unique_records, count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY 1")
def duplicate_counters(spark, tables):
    return C.duplicate_counters(fingerprinted(tables), ["fp"], ["lang"])


@query("SELECT b.item_id % 4 AS file, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text) THEN b.text END) AS overlap FROM benchmark b GROUP BY 1")
def contamination_exact(spark, tables):
    held = tables("benchmark").select((F.col("item_id") % 4).alias("file"), F.sha2("text", 256).alias("fp"))
    return C.contamination(fingerprinted(tables), held, ["fp"], "file")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination_passage(spark, tables):
    """Extension: benchmark passages inside documents."""
    return passages_within(tables("documents"), tables("benchmark"), "doc_id", "item_id").distinct()


@query(
    "WITH r AS (SELECT doc_id, text, CASE WHEN source = 'src3' THEN 'signal' WHEN lang = 'fr' AND n_chars < 300 THEN 'unsafe_share' END AS rule FROM documents),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY text, rule IS NULL ORDER BY doc_id) AS n FROM r)"
    " SELECT doc_id, CASE WHEN rule IS NOT NULL THEN rule WHEN n > 1 THEN 'duplicate' END AS removed_reason FROM k"
)
def curate_with_reasons(spark, tables):
    reasons = [("signal", F.col("source") == "src3"), ("unsafe_share", (F.col("lang") == "fr") & (F.col("n_chars") < 300))]
    return C.curated(fingerprinted(tables), reasons, ["fp"], ["doc_id"]).select("doc_id", "removed_reason")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('17-' || event_id), event_id) AS r FROM events) WHERE r <= 20")
def stratified_sample(spark, tables):
    return C.stratified(tables("events"), "event_type", "event_id", 20, 17).select("event_type", "event_id")


_GROUPS = """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
g AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i, coalesce(lines, []) AS lines FROM documents
  LEFT JOIN (SELECT doc_id, list(DISTINCT md5(line)) AS lines FROM l WHERE length(line) >= 20 GROUP BY 1) USING (doc_id)),
r(i, doc_id, accepted, seen) AS (
  SELECT 0::BIGINT, NULL::BIGINT, true, (SELECT list(DISTINCT md5(text)) FROM benchmark)
  UNION ALL
  SELECT g.i, g.doc_id, NOT list_has_any(seen, lines), CASE WHEN list_has_any(seen, lines) THEN seen ELSE list_concat(seen, lines) END FROM r JOIN g ON g.i = r.i + 1)
SELECT doc_id, accepted FROM r WHERE i > 0"""


@query(_GROUPS)
def whole_group_acceptance(spark, tables):
    """Documents from the longest on; one that shares a line with any accepted before, or with the benchmark, is rejected whole."""
    d = tables("documents").select("doc_id", F.struct(-F.col("n_chars"), F.col("doc_id")).alias("place"), "text")
    lines = d.select("doc_id", "place", F.explode_outer(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 20)).alias("line")).select("doc_id", "place", F.md5("line").alias("fp"))
    return accept_groups(lines, "doc_id", "fp", "place", known=tables("benchmark").select(F.md5("text").alias("fp")), finish_rows=1000)


@query(
    "WITH c AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents d WHERE source NOT IN ('src0', 'src1') AND NOT EXISTS (SELECT 1 FROM documents k WHERE k.source IN ('src0', 'src1') AND k.text = d.text))"
    " SELECT doc_id FROM c WHERE r = 1"
)
def known_index_top_up(spark, tables):
    """Documents of the other sources that a kept index of two sources' fingerprints does not know, first occurrence each."""
    d = fingerprinted(tables).select("doc_id", "source", "fp")
    base = F.col("source").isin("src0", "src1")
    index = KnownFingerprints(spark, f"{shared_folder(spark)}/tidemill-core/{spark.sparkContext.applicationId}/known-{uuid.uuid4().hex}")
    index.add(d.where(base), "fp")
    return index.fresh(d.where(~base), "fp", ["doc_id"]).select("doc_id")


_DAYS = "SELECT *, CAST(ts AS DATE) - DATE '2024-01-01' AS day FROM events"


@query(
    f"WITH e AS ({_DAYS}), b AS (SELECT event_type, count(*) AS have FROM e WHERE day < 2 GROUP BY 1), c AS (SELECT e.*, row_number() OVER (PARTITION BY e.event_type ORDER BY event_id) AS r FROM e WHERE day >= 2)"
    " SELECT c.event_type, c.event_id FROM c LEFT JOIN b ON c.event_type = b.event_type WHERE r <= 200 - coalesce(have, 0)"
)
def top_up(spark, tables):
    e = tables("events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))
    return C.top_up(e.where("day < 2"), e.where("day >= 2"), "event_type", ["event_id"], 200).select("event_type", "event_id")


@query(
    f"WITH e AS ({_DAYS}), n AS (SELECT event_type, day, sum(count(*)) OVER (PARTITION BY event_type ORDER BY day) AS total FROM e GROUP BY 1, 2), f AS (SELECT event_type, min(day) AS reached FROM n WHERE total >= 300 GROUP BY 1)"
    " SELECT CASE WHEN count(*) = 5 THEN max(reached) END AS stop_episode, count(*) AS classes_reached FROM f"
)
def top_up_stop(spark, tables):
    e = tables("events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))
    return C.top_up_stop(e, "event_type", "day", 300, 5)


@query(
    "WITH d AS (SELECT unnest(['click', 'view', 'purchase', 'error', 'signup', 'teleport']) AS event_type), n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)"
    " SELECT d.event_type, coalesce(n.n, 0) AS n FROM d LEFT JOIN n ON d.event_type = n.event_type WHERE coalesce(n.n, 0) < 2000"
)
def class_shortages(spark, tables):
    return C.shortages(tables("events"), "event_type", ["click", "view", "purchase", "error", "signup", "teleport"], 2000)


@query("SELECT doc_id FROM documents ORDER BY md5('5-' || doc_id), doc_id LIMIT 100")
def seeded_shuffle_limit(spark, tables):
    return C.shuffled(tables("documents"), "doc_id", 5, 100).select("doc_id")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('9-' || doc_id), doc_id) <= least((SELECT count(*) FROM documents) // 10, 200) THEN 'test' ELSE 'train' END AS part FROM documents")
def train_test_split(spark, tables):
    return C.split(tables("documents"), "doc_id", 9).select("doc_id", "part")


@query("SELECT 'documents' AS origin, doc_id AS id, lang FROM documents UNION ALL SELECT 'benchmark', item_id, NULL FROM benchmark")
def union_records(spark, tables):
    d = tables("documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "lang")
    return C.union_records(d, tables("benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id")))


@query("SELECT count(*) AS overlap FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)")
def set_intersection(spark, tables):
    return fingerprinted(tables).select("fp").intersect(tables("benchmark").select(F.sha2("text", 256).alias("fp"))).agg(F.count("*").alias("overlap"))


@query("SELECT coalesce(source, 'total') AS component, count(*) AS n, count(DISTINCT text) AS unique_texts FROM documents GROUP BY ROLLUP (source)")
def corpus_composition(spark, tables):
    return fingerprinted(tables).rollup("source").agg(F.count("*").alias("n"), F.count_distinct("fp").alias("unique_texts")).select(F.coalesce("source", F.lit("total")).alias("component"), "n", "unique_texts")


_AUDIT = "SELECT lang, count(*) AS records, count(DISTINCT text) AS unique_records, count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (WHERE n_chars < 50) AS illegal, count(*) FILTER (WHERE length(text) <> n_chars) AS label_errors FROM documents GROUP BY 1"


def audited(tables):
    checks = {"illegal": F.col("n_chars") < 50, "label_errors": U.label_errors(F.col("n_chars"), F.length("text").cast("long"))}
    return U.counters(fingerprinted(tables), ["lang"], checks, ["fp"])


@query(_AUDIT)
def audit_counters(spark, tables):
    return audited(tables)


@query(f"SELECT count(*) AS datasets, bool_and(duplicates = 0 AND illegal = 0 AND label_errors = 0) AND NOT EXISTS (SELECT 1 FROM documents d JOIN benchmark b ON d.text = b.text) AS passed FROM ({_AUDIT})")
def audit_verdict(spark, tables):
    held = tables("benchmark").select(F.lit("benchmark").alias("file"), F.sha2("text", 256).alias("fp"))
    return U.verdict(audited(tables), ["duplicates", "illegal", "label_errors"], C.contamination(fingerprinted(tables), held, ["fp"], "file"))
