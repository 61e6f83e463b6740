"""Paired experiments on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import experiments as X
from tidemill.plans.registry import query


@query(
    "SELECT user_id % 4 AS condition, count(*) AS runs, coalesce(round_even(sum((event_type = 'purchase')::INT)::DOUBLE / sum((event_type <> 'error')::INT), 4), 0.0) AS purchase_share,"
    " coalesce(round_even(avg((value > 50)::INT), 3), 0.0) AS high_rate FROM events GROUP BY 1"
)
def condition_rollup(spark, tables):
    e = tables("events").withColumn("condition", F.col("user_id") % 4)
    is_ = lambda c: c.cast("int")
    return X.condition_rollup(e, "condition", {"purchase_share": (is_(F.col("event_type") == "purchase"), is_(F.col("event_type") != "error"))}, {"high_rate": is_(F.col("value") > 50)})


_RUNS = "SELECT CAST(ts AS DATE) AS day, user_id // 4 AS unit, user_id % 4 AS condition, max((event_type = 'purchase')::INT) AS bought, min(event_id) AS first_event FROM events GROUP BY 1, 2, 3"


@query(
    f"WITH r AS ({_RUNS}), p AS (SELECT day, unit, max(CASE WHEN condition = 0 THEN bought END) - max(CASE WHEN condition = 1 THEN bought END) AS e,"
    " max(CASE WHEN condition = 1 THEN first_event END) - max(CASE WHEN condition = 0 THEN first_event END) AS d FROM r WHERE condition IN (0, 1) GROUP BY 1, 2 HAVING count(*) = 2)"
    " SELECT count(*) AS pairs, sum(e) AS effect_sum, sum(d) AS lead_sum, coalesce(round_even(avg(e), 4), 0.0) AS effect, coalesce(round_even(avg(d), 4), 0.0) AS lead FROM p"
)
def paired_effect(spark, tables):
    e = tables("events")
    runs = e.groupBy(F.to_date("ts").alias("day"), F.expr("user_id div 4").alias("unit"), (F.col("user_id") % 4).alias("condition")).agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"), F.min("event_id").alias("first_event"))
    return X.paired_effects(runs, ["day", "unit"], "condition", 0, 1, {"effect": ("bought", 1), "lead": ("first_event", -1)})


@query("SELECT user_id, count(DISTINCT event_type) AS scenes FROM events GROUP BY 1 HAVING count(DISTINCT event_type) <> 1")
def scene_consistency(spark, tables):
    return X.scene_consistency(tables("events"), ["user_id"], F.col("event_type"))


@query("SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) AS first_purchase, min(CASE WHEN event_type = 'error' THEN event_id END) AS first_error FROM events GROUP BY 1")
def first_tick(spark, tables):
    t = F.col("event_id")
    return tables("events").groupBy("user_id").agg(X.first_tick(t, F.col("event_type") == "purchase").alias("first_purchase"), X.first_tick(t, F.col("event_type") == "error").alias("first_error"))


@query("SELECT o_custkey AS seed, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def seed_uniqueness(spark, tables):
    return X.duplicate_seeds(tables("orders").select(F.col("o_custkey").alias("seed")), "seed")
