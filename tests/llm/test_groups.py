"""Near-duplicate groups: fingerprints and vectors against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import simhash_mih
from tidemill.llm.cells import save
from tidemill.llm.graph import components, spanning
from tidemill.llm.pq_neardup import pq_neardup
from tidemill.llm.simhash_mih import near_pairs, similar_groups, simhash_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def closure(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, edge_docs, no_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    fp = [fingerprint(r.text) for r in rows]
    root = closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    least = {r: min((rows[i].doc_id for i in range(len(rows)) if root[i] == r and rows[i].doc_id is not None), default=None) for r in root}
    want = sorted((str(rows[i].doc_id), fp[i], str(least[root[i]])) for i in range(len(rows)))
    got = sorted((str(r.row.doc_id), r.fp0 % 2**64, str(r.component)) for r in simhash_groups(edge_docs).collect())
    assert got == want
    assert simhash_groups(no_docs).count() == 0


def test_multi_index_misses_no_pair(spark):
    """Random fingerprints with planted neighbours, in blocks that must be dealt to several tasks."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set(base.tolist()) | {int(rng.integers(0, 2**63)) for _ in range(200)}
    for b in base.tolist():
        for _ in range(25):
            x = b
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps |= {(7 << 32) + i for i in range(700)}  # one segment value for all
    a = np.array(sorted(fps), np.uint64)
    near = [(i, i + 1 + int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3)]
    want = closure(len(a), near)
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp0 long")
    edges = near_pairs(df.select(F.col("fp0").alias("node"), "fp0"), 1, 3, [(0, 0, 32), (0, 32, 32)]).collect()
    place = {int(x): i for i, x in enumerate(a.view(np.int64).tolist())}
    got = closure(len(a), [(place[e.a], place[e.b]) for e in edges])
    assert got == want


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(x), int(y)) for x, y in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = closure(1100, pairs)
    assert all(want[n] == r for n, r in got.items())
    assert set(got) == {x for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_keeps_connections():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 100, 400), rng.integers(0, 100, 400)
    e, f = spanning(100, [(a[:200], b[:200]), (a[200:], b[200:])])
    assert len(e) < 100 and closure(100, zip(e, f, strict=True)) == closure(100, zip(a, b, strict=True))


def test_similar_groups(spark, edge_docs, no_docs):
    clashing = edge_docs.withColumns({c: F.lit(c) for c in ("first", "root", "_uid", "uid", "twin", "size", "digest", "few")})
    done = similar_groups(clashing).select("row", F.col("root").alias("group"), F.col("first").alias("keep"))
    assert done.select("row.*").columns == clashing.columns
    got = done.select("row.doc_id", F.col("group").alias("root"), F.col("keep").alias("first")).collect()
    kept = [r for r in got if r.first]
    assert len({r.root for r in got}) == len(kept)
    near = {r.root for r in got if r.doc_id is not None and 14 <= r.doc_id <= 17}
    assert len(near) == 1  # copies with one word changed
    assert len({r.root for r in got if r.doc_id in (5, 6)}) == 1
    assert not {r.root for r in got if r.doc_id == 11} & near
    assert similar_groups(no_docs).count() == 0


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def check_groups(spark, texts):
    """similar_groups against the components of brute-force Jaccard; returns their number."""
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i, x in enumerate(sets) for j in range(i) if len(x & sets[j]) >= 0.8 * len(x | sets[j])]
    want = closure(len(texts), pairs)
    got = similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("row.doc_id", "root", "first").collect()
    least = {}
    for r in got:
        least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    assert {r.doc_id: least[r.root] for r in got} == dict(enumerate(want))
    assert sum(r.first for r in got) == len(set(want))
    return len(set(want))


def edited(words, places):
    return " ".join(f"{w}{places[i]}" if i in places else w for i, w in enumerate(words))


def test_hub_of_far_copies(spark):
    """Copies that are similar to a hub only: pairs that look nearer fail the exact check, those to the hub must not be lost."""
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 104)]
    texts = [edited(words, {52: "h"})] + [edited(words, {52: "h", int(i): f"x{k}", int(j): f"y{k}"}) for k, (i, j) in enumerate(zip(rng.integers(6, 45, 150), rng.integers(60, 98, 150), strict=True))]
    assert check_groups(spark, texts) < 5


@pytest.mark.parametrize("n", [100, 400])
def test_recall_of_isolated_long_pairs(spark, n):
    """Pairs at 0.8 to 0.85 of longer texts, with no other to help: at least 97 of 100 are found, and nothing else."""
    rng = np.random.default_rng(n)
    texts = []
    while len(texts) < 240:
        w = [f"w{x}" for x in rng.integers(0, 10**7, n)]
        v = " ".join(edited(w, {int(i): "x" for i in rng.choice(n, max(1, n // 50), False)}).split())
        a, b = shingle_set(" ".join(w)), shingle_set(v)
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            texts += [" ".join(w), v]
    root = {r.doc_id: r.root for r in similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("row.doc_id", "root").collect()}
    assert np.mean([root[i] == root[i + 1] for i in range(0, 240, 2)]) >= 0.97
    assert len(set(root.values())) >= 120


def test_open_groups_in_blocks(spark, monkeypatch):
    """The same where a group is asked about in many blocks, and tables of sets are cut."""
    from tidemill.llm import simhash_mih

    monkeypatch.setattr(simhash_mih, "BLOCK", 16)
    monkeypatch.setattr(simhash_mih, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(simhash_mih, "HELD", 40)
    monkeypatch.setattr(simhash_mih, "CELL", 3000)
    rng = np.random.default_rng(12)
    texts = []
    for h in range(3):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 104)]
        texts += [edited(words, {52: "h"})] * 2 + [edited(words, {52: "h", int(i): f"x{k}", int(j): f"y{k}"}) for k, (i, j) in enumerate(zip(rng.integers(6, 45, 60), rng.integers(60, 98, 60), strict=True))]
        texts += [edited(words, {int(x): f"z{h}{k}" for x in rng.choice(104, 5 + k % 3, False)}) for k in range(40)]
    check_groups(spark, texts)


@pytest.mark.parametrize("held", [1, 37, 1 << 16])
def test_blocks_come_in_any_batches(spark, monkeypatch, held):
    """Members of crowded values are compared task by task, whatever the size of what a task holds."""
    from tidemill.llm import simhash_mih

    monkeypatch.setattr(simhash_mih, "HELD", held)
    monkeypatch.setattr(simhash_mih, "BLOCK", 8)
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.int64) | 5 << 40)
    df = spark.createDataFrame([(int(x), int(x)) for x in fps], "node long, fp0 long")
    met = df.select(F.lit(0).alias("seg"), (F.col("node") % 3).alias("key"), "node", "fp0", F.lit(9).alias("blocks"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        edges = simhash_mih._blocked(met, 1, 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    place = {int(x): i for i, x in enumerate(fps)}
    near = [(place[int(a)], place[int(b)]) for a in fps for b in fps if a < b and a % 3 == b % 3 and (int(a) ^ int(b)).bit_count() <= 2]
    assert closure(len(fps), [(place[e.a], place[e.b]) for e in edges]) == closure(len(fps), near)


def test_repeats_do_not_count(spark):
    """Equal shingle sets, one with a passage repeated, are one group; a shingle that outweighs all others makes no copies."""
    rng = np.random.default_rng(10)
    free = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = []
    for _ in range(10):
        w, loop = free(300), free(16)
        texts += [" ".join(w + loop * k) for k in (2, 12, 25)]
    texts += [" ".join(free(40) + ["la"] * 100) for _ in range(6)]
    assert check_groups(spark, texts) == 16


def test_isolated_pairs(spark):
    """Pairs at 0.8 and somewhat more, of texts of few words, meet without any others to help."""
    rng = np.random.default_rng(11)
    texts = []
    for n in (8, 9, 10, 14, 20, 28):
        for _ in range(30):
            w = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            texts += [" ".join(w), " ".join([*w, "more"])]
    texts += ["one", "one", "One", "", "two words", "two  words"]
    check_groups(spark, texts)


def test_crowded_shingles(spark):
    """Very many short sets with a common hash are dealt to several tasks."""
    from tidemill.llm.simhash_mih import short_links

    sets = [np.sort(np.array([1, 2, *range(10 + i // 4 * 10, 17 + i // 4 * 10), 10**7 + i], np.uint64)) for i in range(400)]
    rows = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, set binary")
    want = [i // 4 * 4 for i in range(400)]
    for large in (50, 4096):
        assert closure(400, [(r.a, r.b) for r in short_links(rows, 0.8, large).collect()]) == want


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 24))
    near = np.concatenate([b + rng.normal(size=(4, 24)) * s for b, s in zip(base[:60], np.linspace(0.02, 0.2, 60), strict=True)])
    return np.concatenate([base, near, base[:10], base[10:12] * 3, np.repeat(base[20:21], 40, 0)])


def test_vectors(spark, vectors):
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [1.0, None] + [0.0] * 22), (9004, [float("nan")] * 24), (9005, [float("inf")] + [1.0] * 23), (9006, [1.0, 2.0]), (9007, [1.0, 2.0]), (9008, [])]
    rows = [(i, v.tolist(), "r") for i, v in enumerate(vectors)] + [(i, v, "r") for i, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string")
    got = {r.row.vec_id: (r.n_links, r.component) for r in pq_neardup(df).collect()}
    assert len(got) == len(rows)
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    n = link.sum(1)
    found = np.array([got[i][0] for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    want = closure(len(x), zip(*np.nonzero(link), strict=True))
    assert np.mean([got[i][1] == want[i] for i in range(len(x))]) > 0.97
    for i in (9001, 9002, 9003, 9004, 9005, 9008):
        assert got[i] == (0, i)
    assert got[9006] == got[9007] == (1, 9006)


@pytest.mark.parametrize("part", [40, 300, 8192])
def test_vectors_on_many_lists(spark, monkeypatch, part):
    """A third of the vectors are noisy copies of one, so that a third of a hundred lists lie there: every link counts."""
    monkeypatch.setattr("tidemill.llm.pq_neardup.LIST_SIZE", 24)
    monkeypatch.setattr("tidemill.llm.pq_neardup.PART", part, raising=False)
    rng = np.random.default_rng(6)
    hot = rng.normal(size=32) + rng.normal(size=(800, 32)) * 0.27
    base = rng.normal(size=(400, 32))
    x = np.concatenate([hot, base, *(base + rng.normal(size=base.shape) * s for s in (0.2, 0.3, 0.45))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.row.vec_id: (r.n_links, r.component) for r in pq_neardup(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    want = closure(len(x), zip(*np.nonzero(link), strict=True))
    assert got == {i: (int(link[i].sum()), want[i]) for i in range(len(x))}


def test_vectors_of_two_lengths(spark):
    """Near but unequal vectors link within each length."""
    rng = np.random.default_rng(7)
    rows = []
    for n, dims in ((60, 8), (20, 5)):
        base = rng.normal(size=(n // 2, dims))
        rows += np.concatenate([base, base + rng.normal(size=base.shape) * 0.05]).tolist()
    got = {r.row.vec_id: (r.n_links, r.component) for r in pq_neardup(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    near = lambda x, y: len(x) == len(y) and np.dot(x, y) >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y)
    pairs = [(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if i != j and near(x, y)]
    want = closure(len(rows), pairs)
    assert got == {i: (sum(a == i for a, _ in pairs), want[i]) for i in range(len(rows))}
    assert {i for i, _ in pairs} >= set(range(60, 80))


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pq_neardup(none).count() == 0
    assert [tuple(r)[1:] for r in pq_neardup(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [(0, 1)]


@pytest.mark.parametrize("large", [16, 4096])
def test_cells_find_what_pairs_find(spark, large):
    """Both searches, with and without crowded segment values, span the same groups."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (25, 4), dtype=np.uint64)
    rows = [base]
    for b in base:
        flips = np.zeros((30, 4), np.uint64)
        for f in flips:
            for bit in rng.choice(256, rng.integers(1, 40), replace=False):
                f[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        rows.append(b ^ flips)
    fp = np.concatenate(rows)
    df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(fp.view(np.int64))], "node long, fp0 long, fp1 long, fp2 long, fp3 long")
    segments = [(w, shift, 16) for w in range(4) for shift in (0, 32)]
    from tidemill.llm.simhash_mih import near_cells

    found = [closure(len(fp), [(e.a, e.b) for e in edges.collect()]) for edges in (near_pairs(df, 4, 56, segments), near_cells(df, 4, 56, segments, large))]
    assert found[0] == found[1] and len(set(found[0])) < 60


def test_exploded_segments_are_not_broadcast(spark, monkeypatch):
    """Balls around all segments make 33 rows a fingerprint and segment, which no estimate of Spark's counts."""
    plans = []
    monkeypatch.setattr(simhash_mih, "save", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or save(df, name))
    distinct = spark.range(2000).select(F.col("id").alias("node"), F.xxhash64(F.col("id") % 1900).alias("fp0"))
    edges = simhash_mih.near_pairs(distinct, 1, 3, [(0, 0, 32), (0, 32, 32)])
    assert {(r.a, r.b) if r.a < r.b else (r.b, r.a) for r in edges.collect()} == {(i, i + 1900) for i in range(100)}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
