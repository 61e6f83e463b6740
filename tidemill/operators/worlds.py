"""Analysis of ecology events: decisions, world summaries, and the two intervention experiments.

Each function names the payload fields that it needs; ``decoded`` reads them in one parse, or from the
shredded columns of a VARIANT payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from tidemill.functions.actions import KINDS, parse_strict
from tidemill.functions.rates import mean, rate
from tidemill.operators.payload import decoded

WORLD = ["seed", "condition"]
#: Fields of a decision.
DECISION = {
    "action": ("action.action", "string"),
    "valid": ("valid", "boolean"),
    "policy_error": ("policy_error", "string"),
    "energy": ("observation.self.energy", "int"),
    "x": ("observation.self.position[0]", "int"),
    "y": ("observation.self.position[1]", "int"),
    "memory": ("observation.memory", "string"),
}
RAW = {"raw_output": ("raw_output", "string")}


def decisions(events: DataFrame) -> DataFrame:
    """Decisions with their action, validity, the actor's own state and memory."""
    more = {"observation": ("observation", "string"), "food_here": ("observation.current_food", "int")}
    made = decoded(events.where("kind = 'decision'"), DECISION | more)
    return made.select(*WORLD, "seq", "tick", "actor_id", "action", "valid", "policy_error", "observation", "energy", "x", "y", F.coalesce("food_here", F.lit(0)).alias("current_food"), "memory")


def demonstrations(events: DataFrame) -> DataFrame:
    """Valid decisions as observation and action texts, in world order.  From a text payload they come as they were written, number by number."""
    decided = events.where("kind = 'decision'")
    if isinstance(events.schema["data"].dataType, VariantType):
        made = decoded(decided, {"valid": ("valid", "boolean"), "observation": ("observation", "string"), "answer": ("action", "string")})
    else:
        made = decided.select(*WORLD, "seq", F.json_tuple("data", "valid", "observation", "action").alias("valid", "observation", "answer"))
    return made.where(F.col("valid").cast("boolean")).select(*WORLD, "seq", "observation", "answer", F.get_json_object("answer", "$.action").alias("action"))


def world_summary(events: DataFrame) -> DataFrame:
    """One row per world: ticks, births, deaths, living, all organisms, living lineages, mean living energy, food."""
    counts = events.groupBy(*WORLD).agg(F.count_if(F.col("kind") == "birth").alias("born"), F.count_if(F.col("kind") == "death").alias("died"))
    being = "array<struct<id:string,lineage:string,energy:int,alive:boolean>>"
    end = decoded(events.where("kind = 'end'"), {"ticks": ("ticks", "int"), "food_units": ("food", "int"), "o": ("organisms", being)}).select(*WORLD, "ticks", "food_units", "o")
    alive = F.filter("o", lambda b: b["alive"])
    total = F.aggregate(alive, F.lit(0), lambda s, b: s + b["energy"])
    lineages = F.array_distinct(F.transform(alive, lambda b: b["lineage"]))
    return end.join(counts, WORLD).select(
        *WORLD, "ticks", "born", "died", F.size(alive).alias("living"), F.size("o").alias("total_organisms"),
        F.size(lineages).alias("living_lineages"), rate(total, F.size(alive), 3).alias("mean_living_energy"), "food_units",
    )


def policy_comparison(events: DataFrame, policy: str = "condition") -> DataFrame:
    """By policy (or condition): decisions, valid ones, births, deaths, living, surviving lineages, mean over worlds of the survivors' mean energy."""
    d = decisions(events).groupBy(policy).agg(F.count("*").alias("decisions"), F.count_if("valid").alias("valid"), F.count_if((F.col("action") == "reproduce") & F.col("valid")).alias("offspring"))
    s = world_summary(events).groupBy(policy).agg(
        F.sum("born").alias("births"), F.sum("died").alias("deaths"), F.sum("living").alias("living"),
        F.sum("living_lineages").alias("surviving_lineages"), mean("mean_living_energy").alias("mean_energy"),
    )
    return d.join(s, policy)


_BEINGS = "array<struct<id:string,energy:int,alive:boolean,position:array<int>>>"


def with_final(runs: DataFrame, role: str, organisms: Column, who: Column) -> DataFrame:
    """Final energy, life and cell of a role, from the world's end row."""
    being = F.get(F.filter(organisms, lambda b: b["id"] == who), F.lit(0))
    return runs.withColumns({f"{role}_final_energy": being["energy"], f"{role}_alive": being["alive"], f"{role}_final_x": being["position"][0], f"{role}_final_y": being["position"][1]})


#: Payload fields of a channel run, and of a rescue run.
TALK = DECISION | RAW | {"receivers": ("receivers", "array<string>"), "cost": ("cost", "int"), "beings": ("organisms", _BEINGS)}
SAVE = DECISION | RAW | {"given_to": ("target", "string"), "beings": ("organisms", _BEINGS)}


def communication_runs(events: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row per seed and condition.  ``scenes``: seed, sender_id, recipient_id, target_x, target_y.

    Decisions of bystanders, and the sender's after the world's first tick, are forced and not the model's.
    """
    first = events.groupBy(*WORLD).agg(F.min("tick").alias("first_tick"))
    s = decoded(events, TALK).join(scenes.select("seed", "sender_id", "recipient_id", "target_x", "target_y"), "seed").join(first, WORLD)
    kind, actor, tick = F.col("kind"), F.col("actor_id"), F.col("tick")
    by_sender, by_recipient = actor == F.col("sender_id"), actor == F.col("recipient_id")
    decision, sent = kind == "decision", (kind == "signal") & by_sender
    heard = sent & F.array_contains("receivers", F.col("recipient_id"))
    mine = decision & by_recipient
    informed = mine & F.contains("memory", F.lit("signalled:"))
    at_target = mine & (F.col("x") == F.col("target_x")) & (F.col("y") == F.col("target_y"))
    forced = decision & ((by_sender & (tick > F.col("first_tick"))) | ~(by_sender | by_recipient))
    own, failed, valid = decision & ~forced, F.col("policy_error").isNotNull(), F.col("valid")
    ate = (kind == "forage") & by_recipient
    s = s.withColumn("strict", parse_strict(F.when(own, F.col("raw_output")))["action"].isNotNull())
    runs = s.groupBy(*WORLD).agg(
        F.count_if(decision).alias("decisions"), F.count_if(decision & valid).alias("valid_decisions"),
        F.count_if(forced & by_sender).alias("forced_sender_decisions"), F.count_if(own).alias("model_decisions"),
        F.count_if(own & valid & ~failed).alias("valid_model_decisions"), F.count_if("strict").alias("strict_model_outputs"),
        F.count_if(own & failed).alias("model_policy_errors"), F.count_if(sent).alias("signals"), F.count_if(heard).alias("deliveries"),
        F.count_if(informed).alias("informed_decisions"), F.min(F.when(informed, tick)).alias("first_informed_tick"),
        F.coalesce(F.bool_or(at_target), F.lit(False)).alias("seen_at_target"), F.min(F.when(at_target, tick)).alias("first_target_tick"),
        F.count_if(ate).alias("recipient_forages"), F.min(F.when(ate, tick)).alias("first_forage_tick"),
        F.coalesce(F.sum(F.when(kind == "signal", F.col("cost"))), F.lit(0)).alias("signal_cost"),
        F.max(F.when(kind == "end", F.col("beings"))).alias("o"),
    )
    runs = runs.join(scenes.select("seed", "sender_id", "recipient_id", "target_x", "target_y"), "seed")
    runs = with_final(with_final(runs, "sender", F.col("o"), F.col("sender_id")), "recipient", F.col("o"), F.col("recipient_id"))
    distance = F.abs(F.col("recipient_final_x") - F.col("target_x")) + F.abs(F.col("recipient_final_y") - F.col("target_y"))
    more = {
        "final_distance": distance,
        "final_energy": F.col("recipient_final_energy"),
        "target_reached": F.col("seen_at_target") | (distance == 0),
        "foraged": F.col("recipient_forages") > 0,
    }
    return runs.withColumns(more).drop("o", "seen_at_target")


def role_actions(events: DataFrame, roles: DataFrame) -> DataFrame:
    """How often each role (seed, actor_id, role) took each action."""
    return decisions(events).join(roles, ["seed", "actor_id"]).groupBy(*WORLD, "role", "action").agg(F.count("*").alias("n"))


def messages(events: DataFrame) -> DataFrame:
    """Signals as their payload: what was said, what arrived, and to whom."""
    said = {name: (name, "string") for name in ("message", "delivered_message", "delivery")}
    made = decoded(events.where("kind = 'signal'"), said | {"receivers": ("receivers", "array<string>"), "cost": ("cost", "int")})
    return made.select(*WORLD, "seq", "tick", "actor_id", "message", "delivered_message", "receivers", "delivery", "cost")


def communication_conditions(runs: DataFrame) -> DataFrame:
    """By condition: ratios of sums for decisions, shares of runs for outcomes, means to three places."""
    some = lambda c: rate(F.count_if(c), F.count("*"))
    return runs.groupBy("condition").agg(
        F.count("*").alias("runs"), rate(F.sum("valid_model_decisions"), F.sum("model_decisions")).alias("valid_rate"),
        rate(F.sum("strict_model_outputs"), F.sum("model_decisions")).alias("strict_rate"), F.sum("model_policy_errors").alias("policy_errors"),
        some(F.col("signals") > 0).alias("signal_rate"), some(F.col("informed_decisions") > 0).alias("informed_rate"),
        some(F.col("target_reached")).alias("target_rate"), some(F.col("foraged")).alias("forage_rate"), some(F.col("recipient_alive")).alias("survival_rate"),
        mean("final_distance").alias("mean_final_distance"), mean("final_energy").alias("mean_final_energy"), mean("sender_final_energy").alias("mean_sender_energy"),
        F.sum("signals").alias("signals"), F.sum("signal_cost").alias("signal_cost"),
    )


def rescue_runs(events: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row per seed and condition.  ``scenes``: seed, donor_id, child_id, target_x, target_y."""
    s = decoded(events, SAVE).join(scenes.select("seed", "donor_id", "child_id", "target_x", "target_y"), "seed")
    kind, actor, tick = F.col("kind"), F.col("actor_id"), F.col("tick")
    by_child, by_donor = actor == F.col("child_id"), actor == F.col("donor_id")
    child, donor = (kind == "decision") & by_child, (kind == "decision") & by_donor
    gave = (kind == "share") & by_donor & (F.col("given_to") == F.col("child_id"))
    energy, did = F.col("energy"), F.col("action")
    distance = F.abs(F.col("x") - F.col("target_x")) + F.abs(F.col("y") - F.col("target_y"))
    own, failed, valid = child | donor, F.col("policy_error").isNotNull(), F.col("valid")

    def counted(who: Column) -> Column:
        each = [x for k in sorted(KINDS) for x in (F.lit(k), F.count_if(who & (did == k)))]
        return F.map_filter(F.create_map(*each), lambda _, n: n > 0)

    withheld = donor & (did == "rest") & (F.col("said") == "share")
    s = s.withColumns({"strict": parse_strict(F.when(own, F.col("raw_output")))["action"].isNotNull(), "said": F.get_json_object("raw_output", "$.action")})
    runs = s.groupBy(*WORLD).agg(
        F.count_if(own).alias("model_decisions"), F.count_if(own & valid & ~failed).alias("valid_model_decisions"),
        F.count_if("strict").alias("strict_model_outputs"), F.count_if(own & failed).alias("model_policy_errors"),
        counted(child).alias("child_actions"), counted(donor).alias("donor_actions"), F.count_if(withheld).alias("blocked_share_attempts"),
        F.coalesce(F.bool_or(child & (distance == 0)), F.lit(False)).alias("seen_at_food"), F.max("target_x").alias("target_x"), F.max("target_y").alias("target_y"),
        F.count_if(gave).alias("shares"), F.count_if((kind == "forage") & by_child).alias("child_forages"),
        F.count_if(child & (did == "move") & (energy <= distance)).alias("boundary_moves"), F.count_if(child & (did == "rest") & (energy == 1)).alias("energy_one_waits"),
        F.min(F.when(gave, tick)).alias("first_share_tick"), F.min(F.when(donor, energy)).alias("least_observed_donor_energy"),
        F.max(F.when(kind == "end", F.col("beings"))).alias("o"), F.max("donor_id").alias("donor_id"), F.max("child_id").alias("child_id"),
        (~F.coalesce(F.bool_or((kind == "death") & by_child), F.lit(False))).alias("child_survived"),
    )
    runs = with_final(with_final(runs, "donor", F.col("o"), F.col("donor_id")), "child", F.col("o"), F.col("child_id"))
    at_food = (F.col("child_final_x") == F.col("target_x")) & (F.col("child_final_y") == F.col("target_y"))
    more = {
        "least_donor_energy": F.least("least_observed_donor_energy", "donor_final_energy"), "repeated_shares": F.greatest(F.col("shares") - 1, F.lit(0)),
        "unsafe_shares": F.when(F.col("condition") == "unsafe", F.col("shares")).otherwise(0), "child_reached_food": F.col("seen_at_food") | F.coalesce(at_food, F.lit(False)),
    }
    return runs.withColumns(more).drop("o", "donor_id", "child_id", "seen_at_food", "target_x", "target_y")


def rescue_conditions(runs: DataFrame) -> DataFrame:
    """By condition: ratios of sums for decisions, shares of runs for outcomes, totals, and means to three places."""
    per_decision = lambda c: rate(F.sum(c), F.sum("model_decisions"))
    some = lambda c: rate(F.count_if(c), F.count("*"))
    return runs.groupBy("condition").agg(
        F.sum("model_decisions").alias("model_decisions"), per_decision("valid_model_decisions").alias("valid_rate"),
        per_decision("strict_model_outputs").alias("strict_rate"), per_decision("model_policy_errors").alias("policy_error_rate"),
        F.sum("repeated_shares").alias("repeated_shares"), F.sum("unsafe_shares").alias("unsafe_shares"),
        mean("least_donor_energy").alias("mean_least_donor_energy"), mean("donor_final_energy").alias("mean_donor_final_energy"),
        F.count("*").alias("runs"), some(F.col("shares") > 0).alias("share_rate"), some(F.col("child_forages") > 0).alias("forage_rate"),
        some(F.col("child_survived")).alias("survival_rate"), some(F.col("energy_one_waits") > 0).alias("wait_rate"), F.sum("boundary_moves").alias("boundary_moves"),
    )
