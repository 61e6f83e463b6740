"""Prediction scoring on labelled documents and on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.rates import rate
from tidemill.operators import metrics as M
from tidemill.plans.registry import query

#: The rule whose predictions are scored: long documents are good; some rows get no prediction.
_PREDICTED = "SELECT l.doc_id, l.quality AS expected, CASE WHEN d.n_chars % 7 = 0 THEN NULL WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS predicted, l.toxic, d.lang, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def predictions(tables):
    d, l = tables("documents").select("doc_id", "n_chars", "lang"), tables("labels")
    predicted = F.when(F.col("n_chars") % 7 == 0, None).when(F.col("n_chars") >= 1000, 1).otherwise(0)
    return d.join(l, "doc_id").select("doc_id", F.col("quality").alias("expected"), predicted.alias("predicted"), "toxic", "lang", "n_chars")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def action_histogram(spark, tables):
    return M.histogram(tables("events"), "event_type")


@query(f"SELECT expected, predicted, count(*) AS n FROM ({_PREDICTED}) WHERE predicted IS NOT NULL GROUP BY 1, 2")
def confusion_matrix(spark, tables):
    return M.confusion(predictions(tables), "expected", "predicted")


_RECALL = f"SELECT expected, count(*) AS records, count(*) FILTER (WHERE expected = predicted) AS hits, round_even(count(*) FILTER (WHERE expected = predicted)::DOUBLE / count(*), 4) AS recall FROM ({_PREDICTED}) GROUP BY 1"


@query(_RECALL)
def per_class_recall(spark, tables):
    return M.recall(predictions(tables), "expected", "predicted")


@query(f"SELECT count(*) AS classes, round_even(avg(recall), 4) AS macro_accuracy FROM ({_RECALL})")
def macro_accuracy(spark, tables):
    return M.macro_accuracy(M.recall(predictions(tables), "expected", "predicted"))


@query(
    "SELECT count(*) AS records, count(*) FILTER (WHERE predicted IS NOT NULL) AS n_parsed, round_even(count(*) FILTER (WHERE predicted IS NOT NULL)::DOUBLE / count(*), 4) AS parsed_rate,"
    " count(*) FILTER (WHERE n_chars >= 200) AS n_legal, round_even(count(*) FILTER (WHERE n_chars >= 200)::DOUBLE / count(*), 4) AS legal_rate,"
    f" count(*) FILTER (WHERE expected = predicted) AS n_exact, round_even(count(*) FILTER (WHERE expected = predicted)::DOUBLE / count(*), 4) AS exact_rate FROM ({_PREDICTED})"
)
def eval_rollup(spark, tables):
    return M.eval_rollup(predictions(tables), {"parsed": F.col("predicted").isNotNull(), "legal": F.col("n_chars") >= 200, "exact": F.col("expected") == F.col("predicted")})


@query(
    f"SELECT lang, count(*) AS records, count(*) FILTER (WHERE expected = predicted) AS exact, round_even(count(*) FILTER (WHERE expected = predicted)::DOUBLE / count(*), 4) AS exact_rate,"
    f" count(*) FILTER (WHERE toxic = 1) AS toxic, round_even(count(*) FILTER (WHERE toxic = 1)::DOUBLE / count(*), 4) AS toxic_rate FROM ({_PREDICTED}) GROUP BY 1"
)
def case_rates(spark, tables):
    return M.case_rates(predictions(tables), "lang", {"exact": F.col("expected") == F.col("predicted"), "toxic": F.col("toxic") == 1})


@query(
    "SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS useful, count(*) FILTER (WHERE event_type = 'click') AS signalled,"
    " coalesce(round_even(count(*) FILTER (WHERE event_type = 'click')::DOUBLE / nullif(count(*) FILTER (WHERE event_type IN ('click', 'view')), 0), 4), 0.0) AS signal_rate FROM events GROUP BY 1"
)
def signal_rates(spark, tables):
    useful, signalled = F.count_if(F.col("event_type").isin("click", "view")), F.count_if(F.col("event_type") == "click")
    return tables("events").groupBy("user_id").agg(useful.alias("useful"), signalled.alias("signalled"), rate(signalled, useful).alias("signal_rate"))


@query(
    "SELECT count(*) AS complete_pairs, count(*) FILTER (WHERE both_) AS exact_pairs, round_even(count(*) FILTER (WHERE both_)::DOUBLE / count(*), 4) AS pair_exact_accuracy"
    " FROM (SELECT conv_id, turn // 2 AS p, bool_and(length(text) >= 40) AS both_ FROM conversations GROUP BY 1, 2 HAVING count(*) = 2)"
)
def pair_exact(spark, tables):
    c = tables("conversations").withColumn("p", F.expr("turn div 2"))
    return M.pair_exact(c, ["conv_id", "p"], F.length("text") >= 40)


@query(
    "WITH m AS (SELECT event_type, user_id % 4 AS condition, count(*) AS n, sum(value) AS total FROM events GROUP BY GROUPING SETS ((), (event_type), (user_id % 4)))"
    " SELECT event_type, condition, n, round_even(total, 3) AS total FROM m"
)
def condition_grouping_sets(spark, tables):
    """Extension: several rollups from one scan."""
    e = tables("events").withColumn("condition", F.col("user_id") % 4)
    sets = [[], [F.col("event_type")], [F.col("condition")]]
    return e.groupingSets(sets, "event_type", "condition").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 3).alias("total"))


_GATES = [("exact_rate", ">=", 0.4), ("legal_rate", ">=", 0.9), ("parsed_rate", ">", 0.99)]


@query(
    f"WITH m AS (SELECT unnest(['exact_rate', 'legal_rate', 'parsed_rate']) AS metric, unnest([avg(coalesce(expected = predicted, false)::INT), avg((n_chars >= 200)::INT), avg((predicted IS NOT NULL)::INT)]) AS value FROM ({_PREDICTED})),"
    " g AS (SELECT 'exact_rate' AS metric, '>=' AS comparator, 0.4 AS threshold UNION ALL SELECT 'legal_rate', '>=', 0.9 UNION ALL SELECT 'parsed_rate', '>', 0.99),"
    " j AS (SELECT g.metric, g.comparator, CASE WHEN comparator = '>=' THEN round_even(value, 4) >= threshold ELSE round_even(value, 4) > threshold END AS passed FROM g JOIN m USING (metric))"
    " SELECT *, (SELECT bool_and(passed) FROM j) AS all_passed FROM j"
)
def gate_verdicts(spark, tables):
    one = eval_rollup(spark, tables)
    names = ["exact_rate", "legal_rate", "parsed_rate"]
    long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("m.*")
    wanted = spark.createDataFrame(_GATES, "metric string, comparator string, threshold double")
    return M.gates(long, wanted).select("metric", "comparator", "passed", "all_passed")


@query(
    f"WITH a AS (SELECT lang, round_even(avg(coalesce(expected = predicted, false)::INT), 4) AS r FROM ({_PREDICTED}) GROUP BY 1),"
    f" b AS (SELECT lang, round_even(avg((expected = 1)::INT), 4) AS r FROM ({_PREDICTED}) GROUP BY 1)"
    " SELECT coalesce(a.lang, b.lang) AS lang, round_even((coalesce(a.r, 0) - coalesce(b.r, 0)) * 100, 2) AS delta_points FROM a FULL JOIN b ON a.lang = b.lang"
)
def baseline_deltas(spark, tables):
    p = predictions(tables)
    ours = M.case_rates(p, "lang", {"exact": F.col("expected") == F.col("predicted")})
    base = M.case_rates(p, "lang", {"exact": F.col("expected") == 1})
    return M.class_deltas(ours, base, "lang", "exact_rate")
