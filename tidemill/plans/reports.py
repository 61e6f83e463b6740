"""Reports of simulated runs over an event log that is derived from the events table, so that SQL can check them.

A world is a (seed, condition); three beings act in it (0 sends or gives, 1 receives, 2 stands by), and each world has an end row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import geometry as G
from tidemill.functions import records as R
from tidemill.operators import worlds as W
from tidemill.plans.grid import SIDE, agents
from tidemill.plans.registry import query

#: What each event stands for; ``DIV`` is the integer division of the engine that reads it.
_LOG = {
    "seq": "event_id",
    "seed": "user_id % 20",
    "condition": "CASE event_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'blocked' ELSE 'unsafe' END",
    "tick": "CAST(event_id DIV 3 % 12 AS INT)",
    "role": "CAST(event_id DIV 7 % 3 AS INT)",
    "kind": "CASE WHEN event_type = 'click' THEN 'signal' WHEN event_type = 'purchase' AND event_id DIV 5 % 2 = 0 THEN 'share' WHEN event_type = 'purchase' THEN 'forage'"
    " WHEN event_type = 'error' AND event_id % 50 < 2 THEN 'death' WHEN event_type = 'error' AND event_id % 10 = 2 THEN 'birth' ELSE 'decision' END",
    "action": "CASE event_id DIV 11 % 5 WHEN 0 THEN 'rest' WHEN 1 THEN 'move' WHEN 2 THEN 'share' WHEN 3 THEN 'forage' ELSE 'reproduce' END",
    "valid": "event_id % 13 <> 0",
    "failed": "event_id % 17 = 0",
    "energy": "CAST(event_id DIV 2 % 6 AS INT)",
    "x": "CAST(user_id % 20 % 12 + event_id DIV 4 % 3 AS INT)",
    "y": "CAST(user_id % 20 * 5 % 12 + event_id DIV 9 % 2 AS INT)",
    "told": "event_id % 5 = 0",
    "output": "CASE event_id % 4 WHEN 0 THEN '{\"action\":\"share\",\"target\":\"organism-1\",\"amount\":1}' WHEN 1 THEN '{\"action\":\"rest\"}' WHEN 2 THEN 'no action' END",
    "cost": "CAST(event_id % 2 AS INT)",
    "reached": "event_id DIV 3 % 2 = 0",
    "given_to": "CASE WHEN event_id DIV 13 % 2 = 0 THEN 'organism-1' ELSE 'organism-2' END",
    "torn": "event_id % 101 = 0 OR event_id % 103 = 0",
}
#: What the payload holds: unknown where it is torn off, or missing.
_HELD = ("action", "valid", "failed", "energy", "x", "y", "told", "output", "cost", "reached", "given_to")
_SCENE = {"target_x": "CAST(seed % 12 AS INT)", "target_y": "CAST(seed * 5 % 12 AS INT)"}
#: Energy of the three beings at the end, and the cell of the second; a being without energy is dead.
_END = {
    "e0": "CAST(seed % 9 AS INT)",
    "e1": "CAST(seed * 3 % 9 AS INT)",
    "e2": "CAST((seed + length(condition)) % 4 AS INT)",
    "x1": "CAST(seed % 12 + seed % 2 AS INT)",
    "y1": "CAST(seed * 5 % 12 AS INT)",
}
_columns = lambda exprs, div: ", ".join(f"{e.replace('DIV', div)} AS {c}" for c, e in exprs.items())
_KNOWN = {c: f"CASE WHEN {_LOG['torn']} THEN NULL ELSE {e} END" if c in _HELD else e for c, e in _LOG.items()}
_L = f"WITH l AS (SELECT {_columns(_KNOWN, '//')} FROM events), z AS (SELECT DISTINCT seed, condition FROM l), w AS (SELECT *, {_columns(_SCENE | _END, '//')} FROM z)"


def log(tables):
    """The events with their payload as JSON, and an end row for each world.  Some payloads break off, and some are null."""
    rows = tables("events").selectExpr(*[f"{e.replace('DIV', 'div')} AS {c}" for c, e in _LOG.items()])
    me = F.struct("energy", F.array("x", "y").alias("position"))
    memory = F.when(F.col("told"), F.array(F.lit("organism-0 signalled: food"))).otherwise(F.array().cast("array<string>"))
    receivers = F.when(F.col("reached"), F.array(F.lit("organism-1"), F.lit("organism-2"))).otherwise(F.array().cast("array<string>"))
    data = F.struct(
        F.struct(me.alias("self"), memory.alias("memory")).alias("observation"),
        F.struct("action").alias("action"), "valid", F.when(F.col("failed"), "timeout").alias("policy_error"), F.col("output").alias("raw_output"),
        "cost", receivers.alias("receivers"), F.col("given_to").alias("target"), F.concat(F.lit("m"), F.col("seq").cast("string")).alias("message"),
    )
    whole = F.to_json(data)
    told = F.when(F.col("seq") % 103 == 0, None).when(F.col("seq") % 101 == 0, F.substring(whole, F.lit(1), F.length(whole) - 9)).otherwise(whole)
    acts = rows.select(*W.WORLD, "seq", "tick", "kind", F.concat(F.lit("organism-"), F.col("role").cast("string")).alias("actor_id"), told.alias("data"))
    ends = rows.select(*W.WORLD).distinct().selectExpr("*", *[f"{e} AS {c}" for c, e in _END.items()])

    def being(i: int, lineage: int, x, y):
        e = F.col(f"e{i}")
        return F.struct(F.lit(f"organism-{i}").alias("id"), F.lit(f"lineage-{lineage}").alias("lineage"), e.alias("energy"), (e > 0).alias("alive"), F.array(x, y).alias("position"))

    beings = F.array(being(0, 0, F.lit(1), F.lit(2)), being(1, 1, F.col("x1"), F.col("y1")), being(2, 0, F.lit(3), F.lit(4)))
    end = F.to_json(F.struct(F.lit(12).alias("ticks"), F.col("e1").alias("food"), beings.alias("organisms")))
    return acts.union(ends.select(*W.WORLD, F.lit(-1), F.lit(99), F.lit("end"), F.lit(None), end))


def scenes(tables, *roles: str):
    """Cells and ids of each seed's scene; ``roles`` names the beings in order."""
    seeds = tables("events").selectExpr(f"{_LOG['seed']} AS seed").distinct()
    ids = {f"{role}_id": F.lit(f"organism-{i}") for i, role in enumerate(roles)}
    return seeds.withColumns({c: F.expr(e) for c, e in _SCENE.items()} | ids)


_LIVING = "((e0 > 0)::INT + (e1 > 0)::INT + (e2 > 0)::INT)"
_SUMMARY = f"s AS (SELECT w.seed, w.condition, 12 AS ticks, count(*) FILTER (WHERE kind = 'birth') AS born, count(*) FILTER (WHERE kind = 'death') AS died, any_value({_LIVING}) AS living, 3 AS total_organisms, any_value((e0 > 0 OR e2 > 0)::INT + (e1 > 0)::INT) AS living_lineages, any_value(coalesce(round_even((e0 + e1 + e2) / nullif({_LIVING}, 0), 3), 0.0)) AS mean_living_energy, any_value(e1) AS food_units FROM w JOIN l USING (seed, condition) GROUP BY 1, 2)"


@query(f"{_L}, {_SUMMARY} SELECT * FROM s")
def log_summaries(spark, tables):
    return W.world_summary(log(tables))


@query(
    f"{_L}, {_SUMMARY}, d AS (SELECT condition, count(*) AS decisions, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE valid AND action = 'reproduce') AS offspring FROM l WHERE kind = 'decision' GROUP BY 1),"
    " t AS (SELECT condition, sum(born) AS births, sum(died) AS deaths, sum(living) AS living, sum(living_lineages) AS surviving_lineages, round_even(avg(mean_living_energy), 3) AS mean_energy FROM s GROUP BY 1) SELECT * FROM d JOIN t USING (condition)"
)
def log_policies(spark, tables):
    """Policies side by side, with the reproductions that made offspring."""
    return W.policy_comparison(log(tables))


@query(f"{_L} SELECT seed, condition, CASE role WHEN 0 THEN 'sender' WHEN 1 THEN 'recipient' ELSE 'bystander' END AS role, action, count(*) AS n FROM l WHERE kind = 'decision' GROUP BY ALL")
def log_role_actions(spark, tables):
    names = ("sender", "recipient", "bystander")
    roles = scenes(tables).select("seed", F.inline(F.array(*[F.struct(F.lit(f"organism-{i}").alias("actor_id"), F.lit(r).alias("role")) for i, r in enumerate(names)])))
    return W.role_actions(log(tables), roles)


@query(f"{_L} SELECT seed, condition, seq, tick, 'organism-' || role AS actor_id, CASE WHEN NOT torn THEN 'm' || seq END AS message, CASE WHEN reached THEN 2 WHEN NOT torn THEN 0 END AS n_receivers, cost FROM l WHERE kind = 'signal'")
def log_messages(spark, tables):
    return W.messages(log(tables)).select(*W.WORLD, "seq", "tick", "actor_id", "message", F.size("receivers").alias("n_receivers"), "cost")


_MINE = "kind = 'decision' AND role = 1"
_TALK = f"""{_L}, b AS (SELECT seed, condition, min(tick) AS first_tick FROM l GROUP BY 1, 2),
 j AS (SELECT *, kind = 'decision' AND (role = 2 OR (role = 0 AND tick > first_tick)) AS forced, kind = 'decision' AND (role = 1 OR (role = 0 AND tick = first_tick)) AS own, {_MINE} AND told AS informed, {_MINE} AND x = target_x AND y = target_y AS arrived FROM l JOIN b USING (seed, condition) JOIN w USING (seed, condition)),
 r AS (SELECT seed, condition, count(*) FILTER (WHERE kind = 'decision') AS decisions, count(*) FILTER (WHERE kind = 'decision' AND valid) AS valid_decisions, count(*) FILTER (WHERE forced AND role = 0) AS forced_sender_decisions, count(*) FILTER (WHERE own) AS model_decisions,
 count(*) FILTER (WHERE own AND valid AND NOT failed) AS valid_model_decisions, count(*) FILTER (WHERE own AND seq % 4 < 2 AND NOT torn) AS strict_model_outputs, count(*) FILTER (WHERE own AND failed) AS model_policy_errors, count(*) FILTER (WHERE kind = 'signal' AND role = 0) AS signals,
 count(*) FILTER (WHERE kind = 'signal' AND role = 0 AND reached) AS deliveries, count(*) FILTER (WHERE informed) AS informed_decisions, min(tick) FILTER (WHERE informed) AS first_informed_tick, min(tick) FILTER (WHERE arrived) AS first_target_tick,
 count(*) FILTER (WHERE kind = 'forage' AND role = 1) AS recipient_forages, min(tick) FILTER (WHERE kind = 'forage' AND role = 1) AS first_forage_tick, coalesce(sum(cost) FILTER (WHERE kind = 'signal'), 0) AS signal_cost, any_value(target_x) AS target_x, any_value(target_y) AS target_y,
 any_value(e0) AS sender_final_energy, any_value(e0 > 0) AS sender_alive, any_value(e1) AS final_energy, any_value(e1 > 0) AS recipient_alive, any_value(abs(x1 - target_x) + abs(y1 - target_y)) AS final_distance, bool_or(arrived) OR any_value(abs(x1 - target_x) + abs(y1 - target_y)) = 0 AS target_reached, count(*) FILTER (WHERE kind = 'forage' AND role = 1) > 0 AS foraged FROM j GROUP BY 1, 2)"""


def _talks(tables):
    return W.communication_runs(log(tables), scenes(tables, "sender", "recipient"))


@query(f"{_TALK} SELECT * FROM r")
def log_communication_runs(spark, tables):
    """What each run of the channel came to, forced decisions apart."""
    return _talks(tables).drop("sender_id", "recipient_id", "sender_final_x", "sender_final_y", "recipient_final_x", "recipient_final_y", "recipient_final_energy")


@query(
    f"{_TALK} SELECT condition, count(*) AS runs, coalesce(round_even(sum(valid_model_decisions) / nullif(sum(model_decisions), 0), 4), 0.0) AS valid_rate, coalesce(round_even(sum(strict_model_outputs) / nullif(sum(model_decisions), 0), 4), 0.0) AS strict_rate, sum(model_policy_errors) AS policy_errors,"
    " round_even(avg((signals > 0)::INT), 4) AS signal_rate, round_even(avg((informed_decisions > 0)::INT), 4) AS informed_rate, round_even(avg(target_reached::INT), 4) AS target_rate, round_even(avg(foraged::INT), 4) AS forage_rate, round_even(avg(recipient_alive::INT), 4) AS survival_rate,"
    " round_even(avg(final_distance), 3) AS mean_final_distance, round_even(avg(final_energy), 3) AS mean_final_energy, round_even(avg(sender_final_energy), 3) AS mean_sender_energy, sum(signals) AS signals, sum(signal_cost) AS signal_cost FROM r GROUP BY 1"
)
def log_communication_conditions(spark, tables):
    return W.communication_conditions(_talks(tables))


_AWAY = "abs(x - target_x) + abs(y - target_y)"
_SAVE = f"""{_L}, j AS (SELECT *, kind = 'decision' AND role = 1 AS child, kind = 'decision' AND role = 0 AS donor, kind = 'share' AND role = 0 AND given_to = 'organism-1' AS gave FROM l JOIN w USING (seed, condition)),
 r AS (SELECT seed, condition, count(*) FILTER (WHERE child OR donor) AS model_decisions, count(*) FILTER (WHERE (child OR donor) AND valid AND NOT failed) AS valid_model_decisions, count(*) FILTER (WHERE (child OR donor) AND seq % 4 < 2 AND NOT torn) AS strict_model_outputs, count(*) FILTER (WHERE (child OR donor) AND failed) AS model_policy_errors,
 count(*) FILTER (WHERE child AND action = 'rest') AS child_rests, count(*) FILTER (WHERE donor AND action = 'share') AS donor_gives, count(*) FILTER (WHERE donor AND action = 'rest' AND seq % 4 = 0) AS blocked_share_attempts, count(*) FILTER (WHERE gave) AS shares, count(*) FILTER (WHERE kind = 'forage' AND role = 1) AS child_forages,
 count(*) FILTER (WHERE child AND action = 'move' AND energy <= {_AWAY}) AS boundary_moves, count(*) FILTER (WHERE child AND action = 'rest' AND energy = 1) AS energy_one_waits, min(tick) FILTER (WHERE gave) AS first_share_tick, min(energy) FILTER (WHERE donor) AS least_observed_donor_energy,
 count(*) FILTER (WHERE kind = 'death' AND role = 1) = 0 AS child_survived, any_value(e0) AS donor_final_energy, least(min(energy) FILTER (WHERE donor), any_value(e0)) AS least_donor_energy, greatest(count(*) FILTER (WHERE gave) - 1, 0) AS repeated_shares, CASE WHEN condition = 'unsafe' THEN count(*) FILTER (WHERE gave) ELSE 0 END AS unsafe_shares,
 coalesce(bool_or({_AWAY} = 0) FILTER (WHERE child), false) OR any_value(x1 = target_x AND y1 = target_y) AS child_reached_food FROM j GROUP BY 1, 2)"""


def _rescues(tables):
    return W.rescue_runs(log(tables), scenes(tables, "donor", "child"))


@query(f"{_SAVE} SELECT * FROM r")
def log_rescue_runs(spark, tables):
    """What each rescue came to: shares, forages, moves at the energy boundary, waits at the last energy."""
    done = _rescues(tables).withColumns({"child_rests": F.coalesce(F.col("child_actions")["rest"], F.lit(0)), "donor_gives": F.coalesce(F.col("donor_actions")["share"], F.lit(0))})
    return done.drop("child_actions", "donor_actions", "donor_alive", "donor_final_x", "donor_final_y", "child_final_energy", "child_alive", "child_final_x", "child_final_y")


@query(
    f"{_SAVE} SELECT condition, sum(model_decisions) AS model_decisions, coalesce(round_even(sum(valid_model_decisions) / nullif(sum(model_decisions), 0), 4), 0.0) AS valid_rate, coalesce(round_even(sum(strict_model_outputs) / nullif(sum(model_decisions), 0), 4), 0.0) AS strict_rate,"
    " coalesce(round_even(sum(model_policy_errors) / nullif(sum(model_decisions), 0), 4), 0.0) AS policy_error_rate, sum(repeated_shares) AS repeated_shares, sum(unsafe_shares) AS unsafe_shares, round_even(avg(least_donor_energy), 3) AS mean_least_donor_energy, round_even(avg(donor_final_energy), 3) AS mean_donor_final_energy,"
    " count(*) AS runs, round_even(avg((shares > 0)::INT), 4) AS share_rate, round_even(avg((child_forages > 0)::INT), 4) AS forage_rate, round_even(avg(child_survived::INT), 4) AS survival_rate, round_even(avg((energy_one_waits > 0)::INT), 4) AS wait_rate, sum(boundary_moves) AS boundary_moves FROM r GROUP BY 1"
)
def log_rescue_conditions(spark, tables):
    return W.rescue_conditions(_rescues(tables))


@query(
    "WITH a AS (SELECT c_custkey AS id, (c_custkey % 24)::INT AS ax, (c_custkey // 24 % 24)::INT AS ay FROM customer), g AS (SELECT x, y FROM range(24) t(x), range(24) u(y))"
    " SELECT id, (row_number() OVER (PARTITION BY id ORDER BY x, y) - 1)::INT AS place, x::INT AS x, y::INT AS y FROM a JOIN g ON abs(x - ax) + abs(y - ay) <= 3"
)
def ball_cells(spark, tables):
    """Cells within three steps of each agent, by x, then y."""
    return agents(tables).select("id", F.posexplode(G.ball("x", "y", 3, SIDE, SIDE)).alias("place", "c")).select("id", "place", "c.x", "c.y")


_PROMPT = """'[{"role":"system","content":"s' || event_id % 3 || '"},{"role":"user","content":"' || event_type || '"}]'"""
_DONE = """'[{"role":"assistant","content":"a' || user_id % 5 || '"}]'"""


@query(
    f"SELECT event_id, sha256('{{\"completion\":' || {_DONE} || ',\"prompt\":' || {_PROMPT} || ',\"step\":' || event_id % 4 || '}}') AS record, sha256('{{\"completion\":' || {_DONE} || ',\"prompt\":' || {_PROMPT} || '}}') AS pair, sha256(event_type || chr(10) || {_DONE}) AS meaning FROM events"
)
def record_fingerprints(spark, tables):
    """The three fingerprints of a record: with its metadata, of prompt and completion, and whatever the system message says."""
    e = tables("events").withColumns({"step": F.col("event_id") % 4, "system": F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")), "answer": F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string"))})
    made = R.chat_record(e, F.col("system"), F.col("event_type"), F.col("answer"))
    prompt, done = F.col("prompt"), F.col("completion")
    return made.select("event_id", R.fp_record(done, prompt, F.col("step")).alias("record"), R.fp_prompt_completion(prompt, done).alias("pair"), R.fp_semantic(R.last_user(prompt), done).alias("meaning"))
