"""A sink of JSON lines whose files, file list and summary appear together or not at all.

    spark.dataSource.register(CommittedLines)
    df.write.format("committed-lines").option("path", ...).mode("overwrite").save()

Every row has a ``value`` (a line); other columns are labels, of which each task counts the values.  Tasks
write into a hidden folder beside the target and send a commit message: file name, lines, bytes, SHA-256
and label counts.  The commit drops what failed attempts left, writes ``_files.json`` (one entry a file) and
``_summary.json`` (from the messages, no second pass over the data) and renames the folder; an abort deletes
it.  Files are written through Arrow file systems, so any store with a URI that Arrow knows will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FILES, SUMMARY = "_files.json", "_summary.json"


def opened(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote."""

    name: str
    lines: int
    bytes: int
    sha256: str
    counts: dict[str, dict[str, int]] = field(default_factory=dict)


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        if "value" not in names:
            raise ValueError("committed-lines needs a column value")
        self.path, self.names, self.overwrite = options["path"].rstrip("/"), names, overwrite
        self.facts = json.loads(options.get("summary", "{}"))
        parent, _, base = self.path.rpartition("/")
        self.staging = f"{parent}/.{base}-{uuid.uuid4().hex}"
        # made here, on the driver: a task that outlives an abort finds no folder and cannot bring it back
        store, folder = opened(self.staging)
        store.create_dir(folder, recursive=True)

    def write(self, iterator):
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{uuid.uuid4().hex[:8]}.json"
        store, folder = opened(self.staging)
        lines, size, digest = 0, 0, hashlib.sha256()
        counts = {c: Counter() for c in self.names if c != "value"}
        with store.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                block = "".join(f"{v}\n" for v in batch.column("value").to_pylist() if v is not None).encode()
                out.write(block)
                digest.update(block)
                lines, size = lines + batch.num_rows - batch.column("value").null_count, size + len(block)
                for c, n in counts.items():
                    for pair in batch.column(c).filter(batch.column("value").is_valid()).value_counts().to_pylist():
                        n[str(pair["values"])] += pair["counts"]
        return Written(name, lines, size, digest.hexdigest(), {c: dict(n) for c, n in counts.items()})

    def commit(self, messages: list[Written]) -> None:
        store, folder = opened(self.staging)
        _, final = opened(self.path)
        from pyarrow import fs

        done = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        there = store.get_file_info(final).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} exists")
        kept = {m.name for m in done if m.lines}
        for found in store.get_file_info(fs.FileSelector(folder)):
            if found.base_name not in kept:  # of attempts that failed, or empty
                store.delete_file(found.path)
        counts: dict[str, Counter] = {}
        for m in done:
            for c, n in m.counts.items():
                counts.setdefault(c, Counter()).update(n)
        listed = [{"name": m.name, "lines": m.lines, "bytes": m.bytes, "sha256": m.sha256} for m in done if m.lines]
        summary = {**self.facts, "records": sum(m.lines for m in done), "bytes": sum(m.bytes for m in done), "files": len(listed)}
        summary |= {f"{c}_counts": dict(sorted(n.items())) for c, n in sorted(counts.items())}
        for name, body in ((FILES, listed), (SUMMARY, summary)):
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(json.dumps(body, ensure_ascii=False, sort_keys=True).encode())
        old = f"{folder}-old"
        if there:
            store.move(final, old)
        store.move(folder, final)
        if there:
            store.delete_dir(old)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, folder = opened(self.staging)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class CommittedLines(DataSource):
    """Options: ``path``, and ``summary`` (a JSON object whose facts the summary repeats)."""

    @classmethod
    def name(cls) -> str:
        return "committed-lines"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(dict(self.options), schema.names, overwrite)


def write_lines(records: DataFrame, path: str, facts: dict | None = None, count_by: tuple[str, ...] = (), order: list | str | None = None, overwrite: bool = True) -> dict:
    """Records as JSON lines with file list and summary; returns the summary.

    ``order`` sorts the corpus over its files.  Labels counted may be columns of any type; a null label
    counts as "None".
    """
    spark = records.sparkSession
    spark.dataSource.register(CommittedLines)
    rows = records.orderBy(*([order] if isinstance(order, str) else order)) if order else records
    lines = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])).alias("value"), *[F.col(f"`{c}`").cast("string").alias(c) for c in count_by if c != "value"])
    out = lines.write.format("committed-lines").option("path", path).option("summary", json.dumps(facts or {}))
    out.mode("overwrite" if overwrite else "append").save()
    return read_summary(path)


def read_summary(path: str) -> dict:
    store, folder = opened(path.rstrip("/"))
    with store.open_input_stream(f"{folder}/{SUMMARY}") as f:
        return json.loads(f.read())


def observed_write(df: DataFrame, path: str, metrics: dict, form: str = "parquet") -> dict:
    """Write a table and return aggregates of the rows written (name -> aggregate column), found in the same job."""
    seen = Observation()
    df.observe(seen, *[m.alias(name) for name, m in metrics.items()]).write.mode("overwrite").format(form).save(path)
    return seen.get


def stream_digests(spark: SparkSession, files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """``path``, ``length`` and upper-case ``sha256`` of each file: tasks stream them in blocks, none is held whole.

    Files are dealt by name, one by one to as many tasks as the session has partitions.
    """

    def run(batches):
        for b in batches:
            found = []
            for path in b.column("path").to_pylist():
                store, at = opened(path)
                digest = hashlib.sha256()
                with store.open_input_stream(at) as f:
                    while piece := f.read(block):
                        digest.update(piece)
                found.append(digest.hexdigest().upper())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(found, pa.string())], names=["path", "length", "sha256"])

    return files.select("path", "length").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, "path string, length long, sha256 string")
