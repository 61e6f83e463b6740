"""Sources and sinks: line numbers over splits, committed files, counts in the same pass, streamed digests."""

import hashlib
import json
from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tidemill.sources import records_io as IO
from tidemill.sources.committed import observed_write, read_summary, write_lines


@contextmanager
def splits_of(spark, size):
    """Splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k in names:
            spark.conf.set(k, str(size if k == names[0] else 1))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def odd_file(n, end):
    rows = [("é漢𝒳" * (i % 9) + f" line {i}") if i % 4 else ("" if i % 8 else "  \t　") for i in range(n)]
    return rows, (end.join(rows) + (end if n % 2 else "")).encode()


@pytest.mark.parametrize("size", [11, 90, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_numbers(spark, tmp_path, size, end):
    """Several files, blank lines, CRLF, and splits inside lines and characters."""
    want = {}
    for k, n in enumerate((1, 13, 0, 9)):
        rows, raw = odd_file(n, end)
        (tmp_path / f"f{k}.jsonl").write_bytes(raw)
        want |= {(f"f{k}.jsonl", i): r for i, r in enumerate(rows, 1) if r.strip()}
    with splits_of(spark, size):
        got = IO.read_lines(spark, str(tmp_path)).collect()
    assert {(r.file.rsplit("/", 1)[-1], r.line): r.value for r in got} == want
    assert len(got) == len(want)
    assert all(a.line < b.line for a, b in zip(sorted(got, key=lambda r: r.ord), sorted(got, key=lambda r: r.ord)[1:], strict=False) if a.file == b.file)


GOOD = '{"prompt":[{"role":"system","content":"s"},{"role":"user","content":"{}"}],"completion":[{"role":"assistant","content":"{\\"action\\":\\"rest\\"}"}]}'


@pytest.mark.parametrize("size", [90, 1 << 20])
def test_the_first_bad_line_is_named(spark, tmp_path, size):
    lines = [GOOD, "", GOOD, "é" * 5, GOOD, GOOD.replace("rest", "fly")]
    path = tmp_path / "a.jsonl"
    for bad, end in (("é" * 5, "\r\n"), (None, "\n")):
        kept = lines if bad else [GOOD if x.startswith("é") else x for x in lines]
        path.write_bytes(end.join(kept).encode())
        with splits_of(spark, size), pytest.raises(ValueError, match=f"line {4 if bad else 6}:"):
            IO.read_sft(spark, str(path))
    path.write_text(GOOD + "\n" + GOOD)
    with splits_of(spark, size):
        assert IO.read_sft(spark, str(path)).count() == 2


def test_split_of_record_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([GOOD] * 40) + "\n")
    parts = {}
    for size in (500, 1 << 20):  # splits don't matter
        with splits_of(spark, size):
            parts[size] = {r.place: r.part for r in IO.read_split(spark, str(tmp_path), 3).select("place", "part").collect()}
    assert parts[500] == parts[1 << 20] and sorted(parts[500].values()) == ["test"] * 4 + ["train"] * 36


def test_committed_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    df = spark.range(500).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "rest").otherwise("move").alias("action"), F.lit("é").alias("t")).repartition(5)
    summary = IO.write_corpus(df, path, {"seed": 7}, order="n", count_by=("action",))
    files = json.loads((tmp_path / "corpus/_files.json").read_text())
    assert summary == read_summary(path)
    assert summary["records"] == 500 == sum(f["lines"] for f in files) and summary["seed"] == 7
    assert summary["action_counts"] == {"rest": 167, "move": 333}
    assert {f["name"] for f in files} == {p.name for p in (tmp_path / "corpus").glob("part-*")}
    rows = []
    for f in sorted(files, key=lambda f: f["name"]):
        raw = (tmp_path / "corpus" / f["name"]).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (f["bytes"], f["sha256"])
        rows += [json.loads(x) for x in raw.decode().splitlines()]
    assert [r["n"] for r in rows] == list(range(500)) and rows[0]["t"] == "é"
    assert spark.read.json(path).count() == 500  # readers pass over the list and the summary
    # another one replaces it, or is refused
    with pytest.raises(Exception, match="exists"):
        write_lines(df.limit(3), path, overwrite=False)
    assert read_summary(path)["records"] == 500
    assert write_lines(df.limit(3), path)["records"] == 3 and spark.read.json(path).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["corpus"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "corpus")
    wrong = F.when(F.col("id") == 900, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("id"))
    bad = spark.range(0, 1000, 1, 4).select(wrong.alias("n"))
    with pytest.raises(Exception, match="broken row"):
        write_lines(bad, path)
    assert list(tmp_path.iterdir()) == []
    write_lines(spark.range(10), path)
    with pytest.raises(Exception, match="broken row"):
        write_lines(bad, path)
    assert read_summary(path)["records"] == 10 and [p.name for p in tmp_path.iterdir()] == ["corpus"]


def test_an_empty_corpus_has_a_summary(spark, tmp_path):
    summary = write_lines(spark.range(0), str(tmp_path / "none"), {"why": "nothing"})
    assert (summary["records"], summary["files"], summary["why"]) == (0, 0, "nothing")


def test_counts_of_a_write_are_those_of_a_group(spark, sf, tmp_path):
    """One job for the table and its counts."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    kinds = [r.event_type for r in events.select("event_type").distinct().collect()]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "")
    found = observed_write(events, str(tmp_path / "e"), {"records": F.count("*"), **{k: F.count_if(F.col("event_type") == k) for k in kinds}})
    assert len(jobs.getJobIdsForGroup("observed")) == 1
    spark.sparkContext.setJobGroup("other", "")
    assert found == Counter({r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}) | {"records": events.count()}
    assert spark.read.parquet(str(tmp_path / "e")).count() == found["records"]


def test_digest_of_a_file_over_two_gib(spark, tmp_path):
    big, n = tmp_path / "big.bin", (1 << 31) + 12345
    with open(big, "wb") as f:
        f.truncate(n)
    (tmp_path / "none.bin").write_bytes(b"")  # Spark's listing passes over empty files
    digest, block, left = hashlib.sha256(), bytes(1 << 22), n
    while left:
        digest.update(block[: min(left, len(block))])
        left -= min(left, len(block))
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in IO.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"big.bin": (n, digest.hexdigest().upper())}
