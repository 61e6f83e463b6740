import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import corpus as C
from tidemill.operators import events as E
from tidemill.operators import metrics as M
from tidemill.operators.spatial import blocks, crowd_join, l1_join, nearest_seen, peers
from tidemill.queries import QUERIES
from tidemill.sources import records_io as IO


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_l1_join_equals_theta_join(spark, radius):
    a = spark.range(60).select(F.col("id").alias("i"), (F.col("id") * 7 % 11 - 5).alias("x"), (F.col("id") * 5 % 13 - 6).alias("y"))
    b = spark.range(50).select(F.col("id").alias("j"), (F.col("id") * 3 % 11 - 5).alias("u"), (F.col("id") * 11 % 13 - 6).alias("v"))
    fast = {(r.i, r.j, r.distance) for r in l1_join(a, b, radius, ("x", "y", "u", "v")).collect()}
    rows_a, rows_b = a.collect(), b.collect()
    assert fast == {(p.i, q.j, d) for p in rows_a for q in rows_b if (d := abs(p.x - q.u) + abs(p.y - q.v)) <= radius}


def test_l1_join_has_no_nested_loop(spark):
    a = spark.range(10).select(F.col("id").alias("x"), F.col("id").alias("y"))
    b = spark.range(10).select(F.col("id").alias("u"), F.col("id").alias("v"))
    assert "NestedLoop" not in l1_join(a, b, 2, ("x", "y", "u", "v"))._jdf.queryExecution().toString()


def test_curation_order_and_reasons(spark):
    df = spark.createDataFrame([(1, "a", "signal"), (2, "a", "move"), (3, "a", "move"), (4, None, "move")], "i int, fp string, kind string")
    got = {r.i: r.removed_reason for r in C.curated(df, [("signal", F.col("kind") == "signal")], ["fp"], ["i"]).collect()}
    assert (got[1], got[2], got[3]) == ("signal", None, "duplicate")


def test_split(spark):
    parts = C.split(spark.range(1000), "id", 3).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"test": 100, "train": 900}
    with pytest.raises(ValueError):
        C.split(spark.range(19), "id", 3)


def test_trajectory_must_end(spark):
    df = spark.createDataFrame([(1, 0, "move"), (1, 1, "forage"), (1, 2, "move"), (2, 0, "move")], "w int, seq int, kind string")
    last = F.col("kind") == "forage"
    assert sorted((r.w, r.step) for r in E.trajectory(df, ["w"], ["seq"], last).collect()) == [(1, 0), (1, 1)]
    with pytest.raises(Exception, match="no end"):
        E.trajectory(df, ["w"], ["seq"], last, required=True).collect()


def test_metrics_on_nothing(spark):
    none = spark.createDataFrame([], "expected int, predicted int")
    assert M.eval_rollup(none, {"exact": F.lit(True)}).first().exact_rate == 0.0
    assert M.macro_accuracy(M.recall(none, "expected", "predicted")).first().macro_accuracy == 0.0


def test_macro_of_published_recalls(spark):
    recalls = spark.createDataFrame([(0.755,), (0.82,), (1.0,), (1.0,), (0.745,)], "recall double")
    assert M.macro_accuracy(recalls).first().macro_accuracy == 0.864


def test_record_files(spark, tmp_path):
    good = '{"prompt":[{"role":"system","content":"s"},{"role":"user","content":"{}"}],"completion":[{"role":"assistant","content":"{\\"action\\":\\"rest\\"}"}]}'
    path = tmp_path / "a.jsonl"
    path.write_text(good + "\n\n" + good + "\n")
    assert IO.read_sft(spark, str(path)).count() == 2
    path.write_text(good + "\n" + good.replace("rest", "fly") + "\n")
    with pytest.raises(ValueError, match="line 2"):
        IO.read_sft(spark, str(path))
    assert IO.read_sft(spark, str(path), validate=False).count() == 2
    path.write_text("\n")
    with pytest.raises(ValueError, match="no records"):
        IO.read_sft(spark, str(path))
    digest = IO.file_digests(spark, str(path)).first().sha256
    assert digest == digest.upper() and len(digest) == 64


def test_config_rejects_unknown_keys(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[world]\nwidth = 3\nheigth = 4\n")
    with pytest.raises(ValueError, match="heigth"):
        IO.load_config(str(p), {"world": {"width", "height"}})


def test_repeated_side_is_never_broadcast(spark):
    """Spark's estimate of an exploded table does not count its repeats; broadcasting it cost the driver's memory."""
    a = spark.range(1000).select("id", (F.col("id") % 24).alias("x"), (F.expr("id div 24") % 24).alias("y"), (F.col("id") % 20).alias("energy"))
    near = peers(a, 2, "id", "x", "y", carry=("energy",))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    cells = {r.id: r for r in a.collect()}
    got = {(r.id, r.peer): (r.energy, r.peer_energy) for r in near.collect()}
    want = {(p.id, q.id): (p.energy, q.energy) for p in cells.values() for q in cells.values() if p.id != q.id and abs(p.x - q.x) + abs(p.y - q.y) <= 2}
    assert got == want


def test_donors_and_receivers_need_no_second_join(spark, sf):
    """One join of agents with agents: another by id was planned as a broadcast of all agents."""
    plan = QUERIES["safe_share_opportunities"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_crowded_cells(spark):
    """Blocks of rows and counted cells give what rows give: cells fuller than a block, equal rows, worlds, rows without a cell."""
    rng = random.Random(5)
    cell = lambda: rng.choice([(0, 0), (0, 1), (2, 1), (7, 7), (None, 1)])
    left = [(i, i % 2, *cell()) for i in range(60)]
    right = [(j // 2, 0, *cell()) for j in range(40)] + [(500 + j, 1, 0, 1) for j in range(1500)]
    a, b = spark.createDataFrame(left, "id int, w int, x int, y int"), spark.createDataFrame(right, "food int, w int, u int, v int")
    at = ("x", "y", "u", "v")
    for keys in ([], ["w"]):
        f = b if keys else b.drop("w")
        want = [(p[0], q[0], d) for p in left for q in right if None not in (p[2], q[2]) and (not keys or p[1] == q[1]) and (d := abs(p[2] - q[2]) + abs(p[3] - q[3])) <= 2]
        assert sorted(tuple(r) for r in crowd_join(a, f, 2, at, keys).select("id", "food", "distance").collect()) == sorted(want)
        got = {r.id: (r.n_visible, r.nearest and tuple(r.nearest)) for r in nearest_seen(a, f, 2, at, keys).collect()}
        for i, w, x, y in left:
            seen = [(abs(x - q[2]) + abs(y - q[3]), q[2], q[3]) for q in right if None not in (x, q[2]) and (not keys or q[1] == w)]
            seen = [s for s in seen if s[0] <= 2]
            assert got[i] == (len(seen), min(seen, default=None))
    assert max(len(r.m) for r in blocks(b, ["w", "u", "v"], "m", 100).collect()) < 200


#: Queries on crowded cells, with an expression of their plan that bounds their work.
CROWDED = {
    "peer_visibility": "cells",
    "reachability_label": "blocks",
    "perception_sorted": "cells",
    "perception_join": "blocks",
    "move_toward": "cells",
    "local_rule": "cells",
    "boundary_moves": "cells",
}


@pytest.mark.parametrize("name", CROWDED)
def test_crowded_queries_make_no_row_pairs_to_fold_or_filter(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert ("collect_list" in plan) == (CROWDED[name] == "blocks")


def test_crowds_pair_few_rows_at_a_time(spark):
    """Blocks of both sides in one chain of explodes would hold a million pairs for each row of the chain."""
    from tidemill.operators.spatial import crowd_join

    left = spark.range(2500).select((F.col("id") % 2).alias("x"), F.lit(0).alias("y"), "id", F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"))
    right = spark.range(1300).select((F.col("id") % 3).alias("fx"), F.lit(0).alias("fy"), F.when(F.col("id") > 2, F.col("id")).alias("food"), F.concat(F.lit("n"), "id").alias("name"))
    for carried in (["food"], ["name", "food"]):
        some = right.select("fx", "fy", *carried).distinct()
        near = crowd_join(left, some, 1, ("x", "y", "fx", "fy"))
        total = lambda df: df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("id", "k", "x", "fx", *carried, "distance"), F.lit(1_000_003)))).first()
        far = F.abs(F.col("x") - F.col("fx"))
        plain = left.crossJoin(some).where(far <= 1).withColumn("distance", far.cast("int"))
        assert total(near) == total(plain)
        near.count()
        lines = near._jdf.queryExecution().executedPlan().toString().splitlines()
        ours = [("Generate" in x and "G") or ("Coalesce" in x and "C") for x in lines if "Generate" in x or "Coalesce " in x]
        assert "".join(ours).startswith("GGCG"), ours
