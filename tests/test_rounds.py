"""Operators in rounds: whole-group acceptance, ancestry, reachability, joins with hot keys."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tidemill.operators.acceptance import accept_groups, accepted_records
from tidemill.operators.lineage import ancestry
from tidemill.operators import reach
from tidemill.operators.reach import distances, reachable
from tidemill.operators.skew import hot_keys, lookup

ROWS = "g string, fp string, o int"


def one_by_one(rows, known=()):
    groups = {}
    for g, fp, o in rows:
        if g is not None:
            held = groups.setdefault(g, [o, set()])
            held[0] = min(held[0], o)
            if fp is not None:
                held[1].add(fp)
    taken, out = set(known), {}
    for g, (_, fps) in sorted(groups.items(), key=lambda x: (x[1][0], x[0])):
        out[g] = taken.isdisjoint(fps)
        if out[g]:
            taken |= fps
    return out


def verdicts(df):
    found = df.collect()
    assert len({r.g for r in found}) == len(found)
    return {r.g: r.accepted for r in found}


@pytest.mark.parametrize("finish", [0, 60, 10**6])
def test_groups_are_accepted_as_one_by_one(spark, finish):
    rng = random.Random(finish)
    rows = [(f"g{i}", f"f{rng.randrange(120)}", rng.randrange(40)) for i in range(90) for _ in range(rng.randint(1, 4))]
    rows += [("empty", None, 3), ("twice", "t", 5), ("twice", "t", 4), (None, "f1", 0)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    known = ["f3", "f7", "never"]
    base = spark.createDataFrame([(x,) for x in [*known, None]], "fp string")
    assert verdicts(accept_groups(df, "g", "fp", "o", base, finish_rows=finish)) == one_by_one(rows, known)
    assert verdicts(accept_groups(df, "g", "fp", "o", finish_rows=finish)) == one_by_one(rows)


def test_chain_of_conflicts(spark):
    """Each of 1,000 groups conflicts with the next only, so every second one is accepted."""
    rows = [(f"{i:04}", f"{i + k}", i) for i in range(1000) for k in (0, 1)]
    got = verdicts(accept_groups(spark.createDataFrame(rows, ROWS), "g", "fp", "o"))
    assert got == {f"{i:04}": i % 2 == 0 for i in range(1000)}
    few = [r for r in rows if r[2] < 9]  # by rounds alone
    assert verdicts(accept_groups(spark.createDataFrame(few, ROWS), "g", "fp", "o", finish_rows=0)) == {f"{i:04}": i % 2 == 0 for i in range(9)}


def test_hot_fingerprint(spark):
    """A third of all groups holds one fingerprint; the first of them is rejected for another reason."""
    rows = [("first", "base", 0), ("first", "hot", 0)]
    df = spark.range(30_000).select(F.concat(F.lit("g"), "id").alias("g"), F.explode(F.array(F.when(F.col("id") % 3 == 0, "hot"), F.concat(F.lit("own"), "id"))).alias("fp"), (F.col("id") + 1).cast("int").alias("o"))
    base = spark.createDataFrame([("base",)], "fp string")
    done = accept_groups(df.union(spark.createDataFrame(rows, ROWS)), "g", "fp", "o", base, finish_rows=0)
    assert done.groupBy("accepted").count().orderBy("accepted").collect() == [(False, 10_000), (True, 20_001)]
    assert {r.g for r in done.where("accepted and substr(g, 2) % 3 = 0 and g <> 'first'").collect()} == {"g0"}


def test_limit_and_records(spark):
    rows = [("a", "1", 1), ("b", "1", 2), ("c", "2", 3), ("d", "3", 4)]
    df = spark.createDataFrame(rows, ROWS)
    assert verdicts(accept_groups(df, "g", "fp", "o", limit=2)) == {"a": True, "b": False, "c": True, "d": False}
    assert sorted(r.g for r in accepted_records(df, "g", "fp", "o").collect()) == ["a", "c", "d"]
    assert accept_groups(spark.createDataFrame([], ROWS), "g", "fp", "o").count() == 0


def test_ancestry_of_five_thousand_generations(spark):
    n = 5000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = ancestry(chain).agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.count_if((F.col("depth") == F.col("id")) & (F.col("root") == 0)).alias("right")).first()
    assert (got.n, got.deepest, got.right) == (n, n - 1, n)


def test_ancestry_of_many_rows(spark):
    """1.5 million rows, half of them children of one."""
    k = F.col("id")
    rows = spark.range(1_500_000).select("id", F.when(k == 0, None).when(k % 2 == 0, F.lit(1)).when(k == 1, 0).otherwise(F.expr("id div 2")).cast("long").alias("parent"))
    got = ancestry(rows).agg(F.count("*").alias("n"), F.count_if((k % 2 == 0) & (F.col("depth") == 2)).alias("hot"), F.max("root").alias("root")).first()
    assert (got.n, got.hot, got.root) == (1_500_000, 749_999, 0)


def test_ancestry_tells_cycles_and_strangers(spark):
    rows = [(1, None), (2, 1), (3, 2), (10, 11), (11, 12), (12, 10), (13, 12), (14, 13), (20, 99), (21, 20), (30, 30), (None, 1), (2, 1), (40, 3), (40, None)]
    df = spark.createDataFrame(rows, "id int, parent int")
    want = {(1, 1, 0), (2, 1, 1), (3, 1, 2), (40, 40, 0)}
    assert {tuple(r) for r in ancestry(df).collect()} == want
    assert {tuple(r) for r in ancestry(df, cycles=True).collect()} == want | {(i, None, None) for i in (10, 11, 12, 13, 14, 30)}
    assert ancestry(df.limit(0)).count() == 0


def bfs(starts, walls, width, height):
    out = {}
    for (by, world), sources in starts.items():
        budget = max(b for *_, b in sources)
        seen = {(x, y): 0 for x, y, _ in sources}
        queue = deque(seen)
        while queue:
            x, y = queue.popleft()
            if seen[x, y] < budget:
                for c in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
                    if 0 <= c[0] < width and 0 <= c[1] < height and c not in seen and (world, *c) not in walls:
                        seen[c] = seen[x, y] + 1
                        queue.append(c)
        out |= {(by, world, *c): d for c, d in seen.items()}
    return out


def test_distances_around_obstacles(spark):
    """Several sources a search, several searches a world, walls that close a room."""
    rng = random.Random(2)
    walls = {(w, rng.randrange(9), rng.randrange(7)) for w in range(3) for _ in range(18)} | {(0, 4, y) for y in range(7)}
    starts = {(i, i % 3): [(rng.randrange(9), rng.randrange(7), rng.randrange(12)) for _ in range(1 + i % 2)] for i in range(12)}
    rows = [(i, w, x, y, b) for (i, w), sources in starts.items() for x, y, b in sources]
    odd = [(50, 0, 9, 0, 3), (51, 0, None, 0, 3), (52, 0, 0, 0, None), (None, 0, 0, 0, 3), (53, 0, 0, 0, -1)]
    df = spark.createDataFrame(rows + odd + rows[:2], "id int, world int, x int, y int, budget int")
    blocked = spark.createDataFrame(sorted(walls), "world int, x int, y int")
    got = {(r.id, r.world, r.x, r.y): r.steps for r in distances(df, blocked, ["id", "world"], ["world"], 9, 7).collect()}
    assert got == bfs(starts, walls, 9, 7)
    targets = spark.createDataFrame([(w, f"t{w}", 6, 3) for w in range(3)], "world int, target string, x int, y int")
    found = {(r.id, r.target): r.steps for r in reachable(df, targets, blocked, ["id", "world"], ["world"], 9, 7).collect()}
    assert found == {(i, f"t{w}"): d for (i, w, x, y), d in got.items() if (x, y) == (6, 3)}
    assert distances(df.limit(0), blocked, ["id", "world"], ["world"], 9, 7).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_is_a_join(spark, how):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"))
    table = spark.range(0, 400, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.createDataFrame([(7, 70), (None, 1)], "k long, v long"))
    assert {r.k for r in hot_keys(rows.where("k is not null"), ["k"]).collect()} == {7}
    assert sorted(map(str, lookup(rows, table, ["k"], how).collect())) == sorted(map(str, rows.join(table, "k", how).collect()))


def test_reach_searches_from_targets(spark, monkeypatch):
    """Crowds of agents and targets are no more searches; blocked starts and targets, several sources, closed rooms."""
    rng = random.Random(4)
    walls = {(w, rng.randrange(9), rng.randrange(7)) for w in range(2) for _ in range(22)}
    starts = {(i, i % 2): [(rng.randrange(9), rng.randrange(7), rng.randrange(9)) for _ in range(1 + i % 3)] for i in range(40)}
    rows = [(i, w, x, y, b) for (i, w), sources in starts.items() for x, y, b in sources]
    goals = [(f"t{i}", *rng.choice([(6, 3), (2, 2), (0, 6), next(iter(sorted(walls)))[1:]])) for i in range(60)]
    asked = []
    monkeypatch.setattr(reach, "distances", lambda s, *a: asked.append(s.count()) or distances(s, *a))
    df = spark.createDataFrame(rows, "id int, world int, x int, y int, budget int")
    targets = spark.createDataFrame(goals + [("out", 9, 0), ("none", None, 0)], "target string, x int, y int")
    found = reachable(df, targets, spark.createDataFrame(sorted(walls), "world int, x int, y int"), ["id", "world"], ["world"], 9, 7, everywhere=True)
    cells = bfs(starts, walls, 9, 7)
    want = sorted((i, t, cells[i, w, x, y]) for (i, w) in starts for t, x, y in goals if (i, w, x, y) in cells)
    assert sorted((r.id, r.target, r.steps) for r in found.collect()) == want
    assert asked[0] <= 2 * 4


@pytest.mark.parametrize("in_row", [4096, 0])
def test_searches_in_rows_and_in_rounds_agree(spark, monkeypatch, in_row):
    """A long way round, walls off the grid, blocked sources, and the shore: what is blocked is told a step later, and not walked."""
    monkeypatch.setattr(reach, "IN_ROW", in_row)
    kept = []
    monkeypatch.setattr(reach, "staged", lambda df, name, f=reach.staged: kept.append(name) or f(df, name))
    walls = {(0, 1, y) for y in range(4)} | {(0, 3, y) for y in range(1, 5)} | {(1, 2, 2)}
    starts = {(1, 0): [(0, 2, 6)], (2, 1): [(2, 2, 2)], (3, 1): [(0, 0, 1), (4, 4, 3)], (4, 2): [(4, 0, 6)]}
    df = spark.createDataFrame([(i, w, *s) for (i, w), sources in starts.items() for s in sources], "id int, world int, x int, y int, budget int")
    blocked = spark.createDataFrame(sorted(walls) + [(1, 5, 1), (1, -1, 2), (2, 0, 5), (None, 1, 1), (2, None, 1)], "world int, x int, y int")
    tell = lambda rows: sorted((r.id, r.world, r.x, r.y, r.steps) for r in rows.collect())
    want = bfs(starts, walls, 5, 5)
    assert tell(distances(df, blocked, ["id", "world"], ["world"], 5, 5)) == sorted((*k, d) for k, d in want.items())
    assert in_row == 0 or not kept  # no table for each step
    shore = {}
    for (i, w, x, y), d in want.items():
        for c in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
            if (w, *c) in walls and d < max(b for *_, b in starts[i, w]):
                shore[i, w, *c] = min(d + 1, shore.get((i, w, *c), 99))
    both = {k: min(d, want.get(k, 99)) for k, d in (want | shore).items()}
    assert tell(distances(df, blocked, ["id", "world"], ["world"], 5, 5, "budget", None, True)) == sorted((*k, d) for k, d in both.items())
    targets = spark.createDataFrame([(f"t{x}{y}", x, y) for x in range(5) for y in range(5)], "target string, x int, y int")
    found = reachable(df, targets, blocked, ["id", "world"], ["world"], 5, 5, everywhere=True)
    assert sorted((r.id, r.target, r.steps) for r in found.collect()) == sorted((i, f"t{x}{y}", d) for (i, _, x, y), d in want.items())
