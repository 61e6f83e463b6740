"""Command line: corpora, audits, experiments and evaluations.

    python -m tidemill.cli smoke OUT --policy heuristic --steps 100 --seed 7 [--founders 4]
    python -m tidemill.cli natural OUT --episodes 16 --steps 60 --seed 1000
    python -m tidemill.cli balanced OUT --base BASE --episodes 32 --steps 60 --seed 2000 --minimum 100
    python -m tidemill.cli stratify OUT --base BASE --per-action 100 --seed 5
    python -m tidemill.cli scenes OUT --family communication --scenes 100 --seed 31 [--base BASE]
    python -m tidemill.cli audit OUT --base BASE --held-out HELD [HELD ...]
    python -m tidemill.cli communication OUT [--seeds 200-211] [--profile v4]
    python -m tidemill.cli rescue OUT [--seeds 900-903]
    python -m tidemill.cli evaluate OUT --base RECORDS --policy heuristic [--limit 200]
    python -m tidemill.cli doctor

Corpora are Parquet folders; an audit that fails ends with status 1.  Settings come from --config (a TOML
file with a [world] section whose keys must be known).
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.actions import KINDS
from tidemill.operators import corpus as C
from tidemill.operators import worlds as W
from tidemill.plans import experiments as X
from tidemill.sources import corpora as P
from tidemill.sources import records_io as IO
from tidemill.sources.committed import observed_write
from tidemill.sources.ecology import POLICIES, Settings, as_mapping, settings_of
from tidemill.sources.scenes import CASES


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemill")
    top.add_argument("--config")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        own = commands.add_parser(name)
        if name != "doctor":
            own.add_argument("out")
        for flag, kind, default in options:
            own.add_argument(flag, type=kind, default=default, **({"required": True} if default is None else {}))

    command("smoke", ("--policy", str, "heuristic"), ("--steps", int, 100), ("--seed", int, 7), ("--founders", int, 0))
    sizes = (("--episodes", int, 16), ("--steps", int, 60), ("--seed", int, 1000))
    command("natural", *sizes)
    command("balanced", ("--base", str, None), *sizes, ("--minimum", int, 1000))
    command("stratify", ("--base", str, None), ("--per-action", int, 100), ("--seed", int, 1))
    command("scenes", ("--family", str, None), ("--scenes", int, 100), ("--seed", int, 1), ("--base", str, ""))
    command("audit", ("--base", str, None))
    commands.choices["audit"].add_argument("--held-out", nargs="+", default=[])
    command("communication", ("--seeds", str, "200-211"))
    commands.choices["communication"].add_argument("--profile", choices=sorted(X.PROFILES), default="v4")
    command("rescue", ("--seeds", str, "900-903"))
    command("evaluate", ("--base", str, None), ("--policy", str, "heuristic"), ("--limit", int, 0), ("--seed", int, 1))
    command("doctor")
    return top


def settings_from(path: str | None) -> Settings:
    if not path:
        return X.NATURAL
    return settings_of(IO.load_config(path, {"world": set(as_mapping(Settings())), "run": {"seed", "steps"}, "dataset": {"episodes", "steps_per_episode", "seed"}}).get("world", {}))


def with_founders(settings: Settings, founders: int) -> Settings:
    """So many founders (0: as set) and at most three times as many living beings."""
    return replace(settings, founders=founders, max_population=max(founders, min(settings.max_population, 3 * founders))) if founders else settings


def seeds_of(text: str) -> range:
    first, _, last = text.partition("-")
    return range(int(first), int(last or first) + 1)


def save(corpus: DataFrame, path: str) -> None:
    """Write a corpus and show how many records each class has, counted while they are written."""
    label, classes = ("action", KINDS) if "action" in corpus.columns else ("case", [c for cases in CASES.values() for c in cases])
    metrics = {"records": F.count("*")} | {c: F.count_if(F.col(label) == c) for c in dict.fromkeys(classes)}
    found = observed_write(corpus, path, metrics)
    print({name: n for name, n in found.items() if n})


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    settings = settings_from(a.config)
    spark = SparkSession.builder.appName("tidemill").getOrCreate()
    read = spark.read.parquet
    if a.command == "doctor":
        print({"spark": spark.version, "python": sys.version.split()[0], "parallelism": spark.sparkContext.defaultParallelism, "checkpoint": spark.conf.get("spark.checkpoint.dir", None)})
    elif a.command == "smoke":
        events = X.single_world(spark, with_founders(settings, a.founders), a.policy, a.seed, a.steps)
        IO.write_run(events, W.world_summary(events), a.out)
    elif a.command == "natural":
        save(C.first_occurrence(P.natural(spark, settings, a.episodes, a.steps, a.seed), ["fp"], ["seed", "seq"]), a.out)
    elif a.command == "balanced":
        save(P.balanced(read(a.base), P.natural(spark, settings, a.episodes, a.steps, a.seed), a.minimum), a.out)
    elif a.command == "stratify":
        save(P.stratified(read(a.base), a.per_action, a.seed), a.out)
    elif a.command == "scenes":
        families = {f: a.scenes for f in (CASES if a.family == "all" else a.family.split(","))}
        save(P.curriculum(spark, families, a.seed, read(a.base) if a.base else None), a.out)
    elif a.command == "audit":
        held = {p.rstrip("/").rsplit("/", 1)[-1]: read(p) for p in a.held_out} or {"none": read(a.base).limit(0)}
        counted, overlaps, verdict = P.audit(read(a.base), held)
        IO.write_report({"counters": counted, "overlaps": overlaps, "verdict": verdict}, a.out)
        return 0 if verdict.first().passed else 1
    elif a.command in ("communication", "rescue"):
        seeds = seeds_of(a.seeds)
        if a.command == "communication":
            runs, rollup = X.communication_results(spark, seeds, a.profile), W.communication_conditions
        else:
            runs, rollup = X.rescue_results(spark, seeds), W.rescue_conditions
        IO.write_report({"runs": runs, "conditions": rollup(runs)}, a.out)
    elif a.command == "evaluate":
        records = fingerprint_order(read(a.base), a.seed, a.limit)
        predictions = P.predict(records, lambda: POLICIES[a.policy](a.seed))
        IO.write_report({"predictions": predictions, **P.evaluation(predictions)}, a.out)
    return 0


def fingerprint_order(records: DataFrame, seed: int, limit: int) -> DataFrame:
    """All records, or so many of them by seeded hash."""
    return C.shuffled(records, "fp", seed, limit) if limit else records


if __name__ == "__main__":
    sys.exit(main())
