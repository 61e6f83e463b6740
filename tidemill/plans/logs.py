"""Event-log queries: memory, trajectories, forensics, opportunities, reciprocity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import events as E
from tidemill.plans.registry import query


@query(
    "SELECT event_id, len(m) AS n_items, array_to_string(m, '|') AS memory FROM (SELECT event_id, list(event_type || ':' || event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS m FROM events)"
)
def memory_last_k(spark, tables):
    item = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))
    return E.memory(tables("events"), ["user_id"], ["event_id"], item, 12).select("event_id", F.size("memory").cast("long").alias("n_items"), F.array_join("memory", "|").alias("memory"))


@query(
    "WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id) AS ends FROM events)"
    " SELECT user_id, event_id, step FROM w WHERE before = 0 AND ends = 1"
)
def trajectory_steps(spark, tables):
    return E.trajectory(tables("events"), ["user_id"], ["event_id"], F.col("event_type") == "purchase").select("user_id", "event_id", F.col("step").cast("long").alias("step"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE regexp_matches(text, '[aeiou]{2}') GROUP BY 1")
def latest_match(spark, tables):
    return E.latest(tables("conversations"), ["conv_id"], "turn", F.col("text").rlike("[aeiou]{2}"), "text")


@query("SELECT user_id, event_id, last_event_type, last_value FROM (SELECT *, lag(event_type) OVER w AS last_event_type, lag(value) OVER w AS last_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'error'")
def death_forensics(spark, tables):
    return E.before_each(tables("events"), ["user_id"], ["event_id"], F.col("event_type") == "error", ["event_type", "value"]).select("user_id", "event_id", "last_event_type", "last_value")


@query(
    "WITH h AS (SELECT date_trunc('hour', ts) AS t, user_id, bool_or(value > 50) AS fed, bool_or(event_type = 'click') AS signalled FROM events GROUP BY 1, 2),"
    " o AS (SELECT DISTINCT a.t, a.user_id, a.signalled FROM h a JOIN h b ON a.t = b.t AND a.user_id <> b.user_id AND a.fed AND NOT b.fed) SELECT count(*) AS opportunities, count(*) FILTER (WHERE signalled) AS signalled FROM o"
)
def asymmetry_opportunities(spark, tables):
    """Actors that have what a peer of the same hour lacks, and how many of them signalled.

    A peer that lacks it exists if the hour's count of such users is positive: no self-join.
    """
    h = tables("events").groupBy(F.date_trunc("hour", "ts").alias("t"), "user_id").agg(F.bool_or(F.col("value") > 50).alias("fed"), F.bool_or(F.col("event_type") == "click").alias("signalled"))
    by = h.groupBy("t").agg(F.count_if(~F.col("fed")).alias("unfed"), F.count_if("fed").alias("n"), F.count_if(F.col("fed") & F.col("signalled")).alias("s")).where("unfed > 0")
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("opportunities"), F.coalesce(F.sum("s"), F.lit(0)).alias("signalled"))


@query(
    "WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id % 12 AS donor, event_id % 12 AS target FROM events WHERE event_type = 'click' AND user_id % 12 <> event_id % 12), n AS (SELECT day, donor, target, count(*) AS n FROM s GROUP BY 1, 2, 3)"
    " SELECT a.day, a.donor, a.target, a.n, b.n AS n_back FROM n a JOIN n b ON a.day = b.day AND a.donor = b.target AND a.target = b.donor AND a.donor < a.target"
)
def reciprocal_shares(spark, tables):
    s = tables("events").where("event_type = 'click'").select(F.to_date("ts").alias("day"), (F.col("user_id") % 12).alias("donor"), (F.col("event_id") % 12).alias("target")).where("donor <> target")
    return E.reciprocal(s, ["day"], "donor", "target").select("day", "donor", "target", "n", "n_back")


@query("SELECT c_nationkey AS lineage, count(*) AS founders, count(*) FILTER (WHERE c_acctbal > 0) AS living, count(*) FILTER (WHERE c_acctbal > 0) > 0 AS survives, coalesce(round_even(avg(CASE WHEN c_acctbal > 0 THEN c_custkey % 40 END), 3), 0.0) AS mean_energy FROM customer GROUP BY 1")
def surviving_lineages(spark, tables):
    alive = F.col("c_acctbal") > 0
    energy = F.coalesce(F.bround(F.avg(F.when(alive, F.col("c_custkey") % 40)), 3), F.lit(0.0))
    return tables("customer").groupBy(F.col("c_nationkey").alias("lineage")).agg(F.count("*").alias("founders"), F.count_if(alive).alias("living"), (F.count_if(alive) > 0).alias("survives"), energy.alias("mean_energy"))


@query("SELECT user_id % 3 AS role, event_type AS action, count(*) AS n, sum(coalesce(CASE WHEN event_type = 'click' THEN 1 END, 0)) AS signal_cost FROM events GROUP BY 1, 2")
def role_histograms(spark, tables):
    cost = F.sum(F.coalesce(F.when(F.col("event_type") == "click", 1), F.lit(0)))
    return tables("events").groupBy((F.col("user_id") % 3).alias("role"), F.col("event_type").alias("action")).agg(F.count("*").alias("n"), cost.alias("signal_cost"))


@query("SELECT user_id, least(min(value), arg_max(value, event_id)) AS least_energy, bool_or(value > 99) OR arg_max(value, event_id) > 90 AS target_reached, count(*) FILTER (WHERE event_id % 7 <> 0) AS model_decisions FROM events GROUP BY 1")
def run_metrics(spark, tables):
    """Least of observed and final energy, target reached ever or at the end, decisions that were not forced."""
    final = F.max_by("value", "event_id")
    return tables("events").groupBy("user_id").agg(F.least(F.min("value"), final).alias("least_energy"), (F.bool_or(F.col("value") > 99) | (final > 90)).alias("target_reached"), F.count_if(F.col("event_id") % 7 != 0).alias("model_decisions"))
