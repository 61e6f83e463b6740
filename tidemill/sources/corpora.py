"""Corpora from simulation and scenes: natural, balanced, stratified, curriculum; audits and evaluation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import actions as A
from tidemill.functions.rates import share_of
from tidemill.functions.text import strict_coordinate
from tidemill.operators import audit as U
from tidemill.operators import corpus as C
from tidemill.operators import metrics as M
from tidemill.operators.payload import decoded
from tidemill.operators.worlds import demonstrations
from tidemill.sources.ecology import Settings, simulate
from tidemill.sources.scenes import fingerprinted, scene_records

_CELLS, _AGENTS = "array<struct<x:int,y:int>>", "array<struct<id:string,distance:int,energy:int>>"


def natural(spark: SparkSession, settings: Settings, episodes: int, steps: int, seed: int) -> DataFrame:
    """Valid demonstrations of so many episodes, in order (episode seed, seq)."""
    worlds = spark.range(seed, seed + episodes).select(F.col("id").alias("seed"), F.lit("natural").alias("condition"))
    return fingerprinted(demonstrations(simulate(worlds, steps, settings)))


def balanced(base: DataFrame, candidates: DataFrame, minimum: int) -> DataFrame:
    """The base without repeats, and new candidates in order until each action has ``minimum``."""
    kept = C.first_occurrence(base, ["fp"], ["seed", "seq"])
    new = C.fresh(candidates, kept, ["fp"], ["seed", "seq"])
    return C.union_records(kept, C.top_up(kept, new, "action", ["seed", "seq"], minimum))


def stratified(corpus: DataFrame, per_action: int, seed: int) -> DataFrame:
    """So many records of each action; an error names those that are short."""
    short = C.shortages(corpus, "action", list(A.KINDS), per_action).collect()  # at most one row per action
    if short:
        raise ValueError("not enough records: " + ", ".join(f"{r.action} {r.n}" for r in short))
    return C.stratified(corpus, "action", "fp", per_action, seed)


def curriculum(spark: SparkSession, families: dict[str, int], seed: int, base: DataFrame | None = None) -> DataFrame:
    """Scenes of each family without repeated records, and without those of a base corpus."""
    made = C.union_records(*[scene_records(spark, f, n, seed) for f, n in families.items()])
    order = ["family", "scene_id", "ordinal"]
    made = fingerprinted(made)
    return C.fresh(made, base, ["fp"], order) if base is not None else C.first_occurrence(made, ["fp"], order)


#: What audits read of an observation.
_SEEN = {
    "o_energy": ("self.energy", "int"),
    "o_threshold": ("self.drives.reproduction_threshold", "int"),
    "o_age": ("self.age", "int"),
    "o_id": ("self.id", "string"),
    "o_lineage": ("self.lineage", "string"),
    "o_x": ("self.position[0]", "int"),
    "o_y": ("self.position[1]", "int"),
    "o_tick": ("tick", "int"),
    "o_food": ("current_food", "int"),
    "o_open": ("open_neighbors", "array<array<int>>"),
    "o_agents": ("visible_agents", _AGENTS),
}


def _observed(df: DataFrame) -> DataFrame:
    """The rows with what their observation holds, from one parse."""
    return decoded(df.withColumn("_seen", F.col("observation")), _SEEN, payload="_seen")


def _legal(df: DataFrame) -> DataFrame:
    """The rows, as observed, with their action and whether it is legal."""
    cells = F.transform("o_open", lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    parsed = _observed(df).withColumn("a", A.parse_strict(F.col("answer")))
    legal = A.legality(F.col("a"), F.col("o_energy"), F.col("o_threshold"), F.col("o_food"), cells, F.col("o_agents"))
    return parsed.withColumn("legal", F.col("a.action").isNotNull() & legal["legal"])


def audit(corpus: DataFrame, held_out: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counters by dataset, overlaps by held-out file, and the verdict over all."""
    both = C.union_records(corpus.withColumn("dataset", F.lit("train")), *[d.withColumn("dataset", F.lit(n)) for n, d in held_out.items()])
    peers = F.coalesce(F.transform("o_agents", lambda a: a["id"]), F.array().cast("array<string>"))
    names = F.concat(F.array("o_id", "o_lineage"), peers)
    distance = F.abs(F.col("o_x") - F.col("target_x")) + F.abs(F.col("o_y") - F.col("target_y"))
    truth = U.reachable(F.col("o_energy"), distance, F.col("o_food") > 0)
    checks = {
        "illegal": ~F.col("legal"), "role_shaped": U.role_shaped(names), "age_errors": F.col("o_age") > F.col("o_tick"),
        "reachability_errors": F.col("reachable_before_exhaustion").isNotNull() & U.label_errors(F.col("reachable_before_exhaustion"), truth),
        "budget_errors": F.col("energy_budget_required").isNotNull() & U.label_errors(F.col("energy_budget_required"), distance + 1),
    }
    counted = U.counters(_legal(both), ["dataset"], checks, ["fp"])
    overlaps = C.contamination(corpus, C.union_records(*[d.select("fp").withColumn("file", F.lit(n)) for n, d in held_out.items()]), ["fp"], "file")
    return counted, overlaps, U.verdict(counted, ["duplicates", *checks], overlaps)


PREDICTED = "observation string, answer string, case string, pair_id string, target_x int, target_y int, raw string, error string"


def predict(records: DataFrame, policy) -> DataFrame:
    """What a policy (made anew in each task by ``policy()``) says to each observation; its failures are logged, not raised."""
    keep = [c.split()[0] for c in PREDICTED.split(", ")][:6]

    def run(frames):
        choose = policy()
        for f in frames:
            raw, error = [], []
            for text in f.observation:
                try:
                    said = choose(json.loads(text))
                    raw.append(said if isinstance(said, str) else json.dumps(said))
                    error.append(None)
                except Exception as e:  # noqa: BLE001
                    raw.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({**{k: f[k] for k in keep}, "raw": raw, "error": error})

    columns = [F.col(c) if c in records.columns else F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in PREDICTED.split(", ")[:6])]
    return records.select(*columns).mapInPandas(run, PREDICTED)


def scored(predictions: DataFrame) -> DataFrame:
    """Predictions with expected and predicted action, strictness, legality and exactness."""
    p = predictions.withColumns({"e": A.parse_strict(F.col("answer")), "p": A.parse_lenient(F.col("raw")), "s": A.parse_strict(F.col("raw"))})
    same = F.coalesce(A.action_json(F.col("e")) == A.action_json(F.col("p")), F.lit(False)) & F.col("p.action").isNotNull()
    return p.select(
        "observation", "case", "pair_id", "target_x", "target_y", F.col("e.action").alias("expected"), F.col("p.action").alias("predicted"), F.col("p.message").alias("message"),
        F.col("s.action").isNotNull().alias("strict"), same.alias("exact"), F.when(F.col("p.action").isNotNull(), A.action_json(F.col("p"))).alias("answer"),
    )


def evaluation(predictions: DataFrame) -> dict[str, DataFrame]:
    """Rollup, confusion, recall, macro accuracy, cases, signal rates and pairs."""
    s = _legal(scored(predictions))
    kind = F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False))
    parsed = F.col("predicted").isNotNull()
    recalls = M.recall(s, "expected", "predicted")
    useful, redundant = F.col("case").isin("sender_useful"), F.col("case").isin("sender_redundant")
    signalled = F.coalesce(F.col("predicted") == "signal", F.lit(False))
    told = strict_coordinate(F.col("message"))
    right = signalled & F.coalesce((told["x"] == F.col("target_x")) & (told["y"] == F.col("target_y")), F.lit(False))
    return {
        "rollup": M.eval_rollup(s, {"parsed": parsed, "strict": F.col("strict"), "legal": F.col("legal") & parsed, "kind": kind, "exact": F.col("exact")}),
        "confusion": M.confusion(s, "expected", "predicted"),
        "recall": recalls,
        "macro": M.macro_accuracy(recalls),
        "cases": M.case_rates(s.where("case is not null"), "case", {"exact": F.col("exact"), "shared": F.coalesce(F.col("predicted") == "share", F.lit(False))}),
        "signals": s.agg(share_of(signalled, useful).alias("useful_signal_rate"), share_of(signalled, redundant).alias("redundant_signal_rate"), share_of(right, useful).alias("payload_accuracy")),
        "pairs": M.pair_exact(s.where("pair_id is not null"), ["pair_id"], F.col("exact")),
    }
