"""Record files: validated and plain reading, sinks with summaries, digests and manifests."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.actions import SPACES, parse_strict
from tidemill.operators.corpus import split
from tidemill.operators.payload import shredded
from tidemill.sources.committed import stream_digests, write_lines
from tidemill.sources.staging import staged

_MESSAGES = "array<struct<role:string,content:string>>"
#: All metadata that any curriculum adds; absent keys are null.
SFT = f"prompt {_MESSAGES}, completion {_MESSAGES}, curriculum string, communication_case string, survival_case string, energy_case string, pair_id string, scene_id string, trajectory_step int, target_food array<int>, context_agents int, visible_food_count int, target_distance int, energy_budget_required int, reachable_before_exhaustion boolean, hard_negative_source string, peers_with_target_in_view int, peers_without_target_in_view int, peers_with_any_food_in_view int, peers_without_any_food_in_view int"


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """All lines with file, ``block`` (where their split begins) and ``ord`` (rises in file order), read once and kept.

    Spark splits files by bytes and gives every line to the split in which it begins, so splits inside a
    line, a character or CRLF are its readers' business.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ord"))
    return staged(lines, "lines")


def _numbered(lines: DataFrame) -> DataFrame:
    """``line``, 1-based within its file: what the splits before it hold, and its place in its own."""
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("ord").alias("first"))  # one row a split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before + 1 - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "block"]).withColumn("line", F.col("ord") + F.col("shift")).drop("shift")


def _blank(value) -> Column:
    return F.btrim(value, F.lit(SPACES)) == ""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their file, 1-based ``line`` number (blank lines count) and ``ord`` (rises in file order)."""
    return _numbered(_placed(spark, path)).where(~_blank("value")).select("value", "file", "line", "ord")


def read_sft(spark: SparkSession, path: str, validate: bool = True, allow_empty: bool = False, numbered: bool = False) -> DataFrame:
    """Records of JSON lines.  A line that is no record, or (if validated) whose completion is no action, is an error that names it.

    The files are read once; what was read is kept in the shared folder, and line numbers are counted there
    only if there is an error to name, or if they are asked for (``numbered``: columns file and line).
    """
    lines = _placed(spark, path)
    place = ["ord", "file", "line"] if numbered else ["ord"]
    lines = _numbered(lines) if numbered else lines
    parsed = lines.where(~_blank("value")).withColumn("r", F.from_json("value", SFT))
    content = F.get(F.col("r.completion"), F.lit(0))["content"]
    fine = F.col("r.prompt").isNotNull() & content.isNotNull()
    if validate:
        parsed = parsed.withColumn("a", parse_strict(content))
        fine = fine & F.col("a.action").isNotNull()
    checked = parsed.withColumn("fine", fine)
    wrong = checked.where(~F.coalesce("fine", F.lit(False))).select("file", "block", "ord", "value").orderBy("ord").limit(1).collect()
    if wrong:
        bad = wrong[0]
        at = (F.col("block") < bad.block) | ((F.col("block") == bad.block) & (F.col("ord") <= bad.ord))
        line = lines.where((F.col("file") == bad.file) & at).count()
        raise ValueError(f"{bad.file}, line {line}: not a valid record: {bad.value[:80]}")
    records = checked.select(*place, "r.*")
    if not allow_empty and records.isEmpty():
        raise ValueError(f"{path} holds no records")
    return records


def read_split(spark: SparkSession, path: str, seed: int, least: int = 20) -> DataFrame:
    """Validated records of JSON lines with their ``part``: test or train, by seeded hash of file name and line."""
    records = read_sft(spark, path, numbered=True)
    return split(records.withColumn("place", F.concat_ws(":", F.substring_index("file", "/", -1), "line")), "place", seed, least)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Logged predictions; a missing prediction is null."""
    action = "struct<action:string,target:string,amount:int,message:string>"
    schema = f"index long, observation string, expected {action}, predicted {action}, raw_output string, strict_json boolean, legal_reason string, error string, communication_case string, pair_id string, target_food array<int>"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def mined_errors(predictions: DataFrame, case: str = "rich_sender_redundant", action: str = "signal") -> DataFrame:
    """Predictions that signalled where it was redundant; rows without a prediction never match."""
    return predictions.where((F.col("communication_case") == case) & F.coalesce(F.col("predicted.action") == action, F.lit(False)))


def load_config(path: str, sections: dict[str, set[str]]) -> dict:
    """A TOML file whose sections and keys must be known."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    for name, values in found.items():
        unknown = set(values) - sections.get(name, set()) if name in sections else {name}
        if unknown:
            raise ValueError(f"unknown configuration: {name}: {sorted(unknown)}")
    return found


def write_corpus(records: DataFrame, path: str, summary: dict, order: str | None = None, count_by: tuple[str, ...] = ()) -> dict:
    """JSON lines, their list and a summary in ``path``, which appear together or not at all; returns the summary.

    The summary repeats the facts given and adds records, bytes, files and the counts of the labels, as the
    tasks report them.
    """
    return write_lines(records, path, summary, count_by, order)


def write_events(events: DataFrame, path: str) -> None:
    """One folder per seed and condition, so that a run's events can be read alone; payloads as VARIANT, which Parquet keeps in typed columns."""
    kept = shredded(events) if dict(events.dtypes)["data"] == "string" else events
    kept.repartition("seed", "condition").sortWithinPartitions("seed", "condition", "seq").write.mode("overwrite").partitionBy("seed", "condition").parquet(path)


def file_digests(spark: SparkSession, path: str, block: int = 1 << 20) -> DataFrame:
    """Upper-case SHA-256 of each file, streamed by the executors in blocks: of any size, none through the driver.  Empty files have no row."""
    return stream_digests(spark, spark.read.format("binaryFile").load(path).select("path", "length"), block)


def repository_state(folder: str = ".") -> dict[str, str | None]:
    """Commit of a folder's repository and whether it has changes; none outside a repository."""
    import subprocess

    def git(*args):
        try:
            done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=30)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    changes = git("status", "--porcelain")
    return {"git_commit": git("rev-parse", "HEAD"), "git_dirty": None if changes is None else str(bool(changes)).lower()}


def manifest(spark: SparkSession, corpus: str, train: int, test: int, prompt: str, **more) -> DataFrame:
    """Lineage of a training run: one row per corpus file with its digest, split sizes, versions and prompt hash."""
    import platform

    import pyspark

    facts = {"train_records": train, "test_records": test, "python": platform.python_version(), "pyspark": pyspark.__version__, **more}
    out = file_digests(spark, corpus).withColumn("prompt_sha256", F.sha2(F.lit(prompt), 256))
    return out.withColumns({k: F.lit(v) for k, v in facts.items()})


def write_run(events: DataFrame, summary: DataFrame, path: str) -> None:
    """A run's events and its summary side by side."""
    write_events(events, f"{path}/events")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report (audit or evaluation) as JSON under its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")
