"""Line dedup, importance resampling and fill-in-middle against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import fim_markers as M
from tidemill.llm import importance as I
from tidemill.llm import line_dedup as L
from tidemill.llm.queries import ORACLES, QUERIES

LOWER = {i: i + 32 for i in range(65, 91)}
STRIP = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda found: sorted(tuple(map(str, r)) for r in found)
    assert rows(ours.select(*columns).collect()) == rows(theirs.select(*columns).fetchall())


# --- line dedup


def brute_lines(rows, least_chars=40, least_docs=5):
    """(lines, dropped, text) of each (doc_id, text); null ids are less than all others."""
    holders = defaultdict(set)
    order = lambda i: (i is not None, i or 0)
    key = lambda x: x.strip(STRIP).translate(LOWER)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add(i)
    gone = {k: max(v, key=order) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def got_lines(df, **more):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in L.without_lines(df, **more).select("row.doc_id", "n_lines", "n_dropped", "text").collect())


def line_texts():
    rng = random.Random(5)
    common = "Subscribe to our NEWSLETTER for more É stories like this one"
    pool = [f"line {k} of the pool, which is long enough to be a key" for k in range(12)]
    rows = [(None, common), (None, f"{common}\n{common}"), (3, None), (4, ""), (5, "\n\n"), (6, "short\nshort\nshort")]
    for i in range(10, 90):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 6))] + [f"own line {i} that nobody else has in any text at all"]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), f"\t {common.upper() if i % 2 else common} \r")
        rows.append((i, "\n".join(lines)))
    rows += [rows[20], rows[20], (30, "another text under an id that is taken\n" + common)]  # a repeated row, and an id with two texts
    rows.append((200, "\n".join([common] * 3 + ["x" * 39, "x" * 40] * 40)))  # repeats within the keeper, and a key at the limit
    return rows


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_lines_equal_brute_force(spark, parts):
    """A key held by a third of all documents, dealt to one task and to many."""
    rows = line_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert got_lines(df) == brute_lines(rows)
        assert got_lines(df, least_chars=3, least_docs=2) == brute_lines(rows, 3, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lines_on_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert got_lines(edge_docs, least_docs=2) == brute_lines(rows, least_docs=2)
    out = L.without_lines(edge_docs)
    assert set(out.columns) == {"row", "n_lines", "n_dropped", "text"}
    assert set(out.schema["row"].dataType.names) == set(edge_docs.columns) - {"text"}
    assert L.without_lines(no_docs).count() == 0


def test_very_long_text_of_lines(spark):
    """A text of some 20 MB, of which every second line goes."""
    common = "this very line is found in five documents, so it goes from all but one"
    long_ = "\n".join(f"{common}\nline {i}" for i in range(240_000))
    df = spark.createDataFrame([(1, long_), *[(i, common) for i in range(2, 7)]], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in L.without_lines(df).select("row.doc_id", "n_lines", "n_dropped").collect()}
    assert got == {1: (480_000, 240_000), 6: (1, 0), **{i: (1, 1) for i in range(2, 6)}}


def test_stream_of_any_batches():
    """A task's decisions do not depend on how its rows come in batches."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n = 400
    h, doc, pos = np.sort(rng.integers(0, 60, n) ** 2 // 40), rng.integers(0, 12, n), np.arange(n)
    order = np.lexsort((pos, -doc, h))
    h, doc, pos = h[order], doc[order], pos[order].astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.zeros(n, np.int32)), pa.array(doc), pa.array(doc * 7), pa.array(pos)], names=L.RECORD)

    def run(size):
        stream = L._Stream(0, 5)
        out = [x for at in range(0, n, size) for x in stream.feed(batch.slice(at, size))] + list(stream.end())
        return sorted(tuple(r.values()) for x in out for r in x.to_pylist())

    assert run(n) == run(1) == run(7) == run(64)
    docs = defaultdict(set)
    for a, b in zip(h.tolist(), doc.tolist(), strict=True):
        docs[a].add(b)
    inner = sorted(docs)[1:-1]
    want = sorted(int(p) for a, b, p in zip(h, doc, pos, strict=True) if a in inner and len(docs[a]) >= 5 and b != max(docs[a]))
    assert sorted(r[5] for r in run(n) if r[0] == L.DROP and r[1] in inner) == want


def test_bitmaps():
    assert L.keeps(L._bitmap(np.array([0, 2, 9]))).tolist() == [False, True, False] + [True] * 6 + [False]


# --- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_importance(rows, target, buckets, run, percent=10, least=20, seed=2024):
    def found(text):
        words = WORD.findall((text or "").translate(LOWER))
        return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(words) - n + 1)], len(words)

    of = [found(text) for _, text in rows]
    s, t = Counter(b for x, _ in of for b in x), Counter(b for text in target for b in found(text)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    out = []
    for (i, _), (x, words) in zip(rows, of, strict=True):
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return sorted(tuple(map(str, r[:5])) for r in out)


def got_importance(df, target, **more):
    done = I.resampled(df, target, **more)
    return sorted(tuple(map(str, r)) for r in done.select("row.doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize(("buckets", "run", "groups"), [(10_000, 1, 16), (97, 2, 5), (500, 3, 1)])
def test_importance_equals_brute_force(spark, monkeypatch, buckets, run, groups):
    """Small chunks and slices, so that every step has many; a word in every document, and a third of all rows alike."""
    monkeypatch.setattr(I, "SLICE_BYTES", 1 << 20)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)] + ["Überfluß", "naïve", "漢字", "x" * 70, "y" * 48, "z" * 49, "42"]
    text = lambda n: " ".join(["The", *rng.choices(words, k=n)])
    copy = text(60)
    rows = [(i, copy if i % 3 == 0 else text(rng.randint(0, 120))) for i in range(240)]
    rows += [(1000, None), (1001, ""), (1002, "?! -"), (1003, text(20_000)), (None, text(30)), rows[4], (5, "one id, two texts " + text(40))]
    target = [text(40) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    want = brute_importance(rows, target, buckets, run)
    got = got_importance(df, goal, buckets=buckets, run=run, groups=groups)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    ranks = lambda found: sorted(int(r[4]) for r in found if r[4] != "None")
    assert ranks(got) == ranks(want) == list(range(1, len(ranks(want)) + 1))
    unique = lambda found: [r for r in found if r[0] not in (str(rows[4][0]), "5")]  # noqa: E731  equal rows may swap their ranks
    assert unique(got) == unique(want)


def test_importance_on_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    none = spark.createDataFrame([], "text string")
    for target in (none, edge_docs.select("text")):
        texts = [r.text for r in target.collect()]
        want = brute_importance(rows, texts, 10_000, 1)
        assert [r[:4] for r in got_importance(edge_docs, target)] == [r[:4] for r in want]
    assert I.resampled(no_docs, edge_docs.select("text")).count() == 0
    assert I.resampled(no_docs, none).count() == 0
    assert set(I.resampled(edge_docs, none).schema["row"].dataType.names) == set(edge_docs.columns) - {"text"}


def test_draw_of_nothing(spark):
    """Too few long documents for one draw."""
    df = spark.createDataFrame([(i, "a b " * 12) for i in range(9)], "doc_id long, text string")
    assert I.resampled(df, df.select("text")).where("rank is not null").count() == 0


def test_crc_of_ranges():
    raw = np.frombuffer(b"".join(bytes([65 + i % 50]) * i for i in range(130)), np.uint8)
    cut = np.r_[0, np.cumsum(np.arange(130))]
    got = I.crc32(raw, cut[:-1], cut[1:])
    assert got.tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    assert len(I.crc32(raw, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


# --- fill-in-middle


def brute_fim(i, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def fim_rows(spark, df, **more):
    done = M.fill_in_middle(df, **more).withColumn("back", M.restored(F.col("output"), F.col("form")))
    return done.select("row.doc_id", "n", "form", F.length("prefix").alias("p"), F.length("middle").alias("m"), "output", "back", "prefix", "middle", "suffix").collect()


def test_fim_equals_brute_force(spark, edge_docs, no_docs):
    rng = random.Random(6)
    odd = ["\x01", "\x02", "\x011", "\x022", "\x02", "1", "2", "<", ">", "P>", "<S", "\n", "\r\n", "é", "é", "漢", "𝒳", "👩‍🚀", " ", "$1", "\\", "\x00"]
    rows = [(i, "".join(rng.choices(odd, k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(None, "no id"), (None, None), (1001, ""), (1002, "has <M> inside"), (1003, "<P>"), (1004, "x" * 300_000 + "\x01"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.n, r.form, r.p, r.m, r.output, r.back) for r in fim_rows(spark, df))))
    want = sorted(map(str, ((i, *brute_fim(i, t), t or "") for i, t in rows)))
    assert got == want
    assert {"plain", "psm", "spm"} == {r.form for r in fim_rows(spark, df)}
    edges = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert sorted(str((r.doc_id, r.output)) for r in fim_rows(spark, edge_docs)) == sorted(str((i, brute_fim(i, t)[-1])) for i, t in edges)
    assert M.fill_in_middle(no_docs).count() == 0
    assert set(M.fill_in_middle(edge_docs).schema["row"].dataType.names) == set(edge_docs.columns) - {"text"}


def test_fim_by_words(spark):
    """Any unit: cuts fall between words with the space behind them."""
    df = spark.createDataFrame([(i, "one two three four five six seven eight") for i in range(60)], "doc_id long, text string")
    rows = fim_rows(spark, df, unit="[^ ]+ ?", plain_from=100)
    assert {r.n for r in rows} == {8}
    assert all(r.back == "one two three four five six seven eight" for r in rows)
    assert all(x == "" or x.endswith(" ") for r in rows for x in ([r.prefix] if r.middle or r.suffix else []))


def test_fim_stays_in_the_jvm(spark, sf):
    plan = QUERIES["op12_fim_markers"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
