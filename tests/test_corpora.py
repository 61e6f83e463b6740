import json

import pytest
from pyspark.sql import functions as F

from tidemill.sources import corpora as P
from tidemill.sources.ecology import Settings
from tidemill.sources.scenes import CASES, scene_records

NATURAL = Settings(initial_food=55, food_regrowth=3, max_food=80)


@pytest.mark.parametrize("family", sorted(CASES))
def test_scenes(spark, family):
    rows = scene_records(spark, family, 8, 31).collect()
    assert sorted(r.case for r in rows) == sorted(CASES[family] * 8)
    assert rows == scene_records(spark, family, 8, 31).collect()
    for r in rows:
        view, did = json.loads(r.observation), json.loads(r.answer)
        assert view["self"]["age"] <= view["tick"]
        if did["action"] == "move":
            assert did["target"] in view["open_neighbors"]
        legal = {"move": did.get("target") in view["open_neighbors"], "forage": view["current_food"] > 0, "share": any(a["id"] == did.get("target") and a["distance"] == 1 for a in view["visible_agents"])}
        assert legal.get(did["action"], True)
        if "boundary" in r.case or r.case in ("food_unreachable", "unrescued_child_wait"):
            assert view["self"]["energy"] == r.target_distance and did == {"action": "rest"} and not r.reachable_before_exhaustion
        if r.case == "sender_useful":
            assert did["message"] == f"food at [{r.target_x},{r.target_y}]"
        if r.case in ("recipient_informed", "recipient_control"):
            assert not view["visible_food"]


def test_every_case_stays_in_the_corpus(spark):
    """No case is lost as a repeat of another; the rows of a walk are numbered and end with the meal."""
    families = {"energy": 20, "rescue": 12, "rich": 10, "trajectory": 12, "rich_trajectory": 12}
    made = P.curriculum(spark, families, 81)
    n = {(r.family, r.case): r["count"] for r in made.groupBy("family", "case").count().collect()}
    for family in ("energy", "rescue", "rich"):
        assert {c: n.get((family, c)) for c in CASES[family]} == dict.fromkeys(CASES[family], families[family])
    walks = {}
    for r in made.where("family like '%trajectory'").orderBy("trajectory_step").collect():
        walks.setdefault((r.family, r.scene_id), []).append(r)
    assert len([k for k in walks if k[0] == "trajectory"]) == 12 and any(k[0] == "rich_trajectory" for k in walks)
    for (family, _), rows in walks.items():
        views = [json.loads(r.observation) for r in rows]
        assert [r.trajectory_step for r in rows] == list(range(len(rows))) and [json.loads(r.answer)["action"] for r in rows][-1] == "forage"
        assert all(f"food at [{r.target_x},{r.target_y}]" in v["memory"][0] for r, v in zip(rows, views, strict=True))
        assert [v["tick"] for v in views] == sorted({v["tick"] for v in views})
        if family == "rich_trajectory":
            assert all(v["visible_food"] or v["current_food"] for v in views)
    _, _, verdict = P.audit(made, {"held": P.curriculum(spark, families, 9100)})
    assert verdict.first().passed


def test_guards(spark):
    from tidemill.functions.records import zip_strict
    from tidemill.operators.corpus import all_distinct
    from tidemill.operators.metrics import throughput
    from tidemill.sources.records_io import repository_state

    assert Settings().calibrated() == Settings()
    with pytest.raises(ValueError, match="rest_gain"):
        Settings(rest_gain=2).calibrated()
    df = spark.createDataFrame([(1, [1, 2], ["a"]), (1, [3], ["b"])], "k int, a array<int>, b array<string>")
    with pytest.raises(ValueError, match="repeats 1"):
        all_distinct(df, ["k"])
    assert all_distinct(df, ["a"]) is df
    with pytest.raises(Exception, match="different lengths"):
        df.select(zip_strict(F.col("a"), F.col("b"))).collect()
    n, seconds, rate = throughput(df)
    assert n == 2 and seconds > 0 and rate > 0
    assert repository_state("/")["git_commit"] is None


def test_audit_passes_and_finds_overlap(spark):
    families = {"communication": 6, "survival": 4, "reachability": 6, "energy": 4}
    train, held = P.curriculum(spark, families, 81), P.curriculum(spark, families, 9100)
    counted, overlaps, verdict = P.audit(train, {"held": held})
    assert verdict.first().passed, counted.collect()
    assert {r.file: r.overlap for r in overlaps.collect()} == {"held": 0}
    _, overlaps, verdict = P.audit(train, {"same": train})
    assert overlaps.first().overlap == train.count() and not verdict.first().passed
    assert P.curriculum(spark, families, 81, base=train).count() == 0


def test_balanced_and_stratified(spark):
    base, more = P.natural(spark, NATURAL, 1, 20, 1000), P.natural(spark, NATURAL, 4, 40, 2000)
    out = P.balanced(base, more, 2)
    n = {r.action: r["count"] for r in out.groupBy("action").count().collect()}
    assert min(n.values()) >= 2 and out.count() == out.select("fp").distinct().count()
    corpus = P.natural(spark, NATURAL, 4, 40, 3000)
    assert {r["count"] for r in P.stratified(corpus, 2, 5).groupBy("action").count().collect()} == {2}
    with pytest.raises(ValueError, match="reproduce"):
        P.stratified(corpus, 500, 5)


def test_evaluation(spark):
    records = scene_records(spark, "communication", 5, 7)
    wanted = {r.observation: r.answer for r in records.collect()}
    perfect = P.evaluation(P.predict(records, lambda: lambda view: wanted[json.dumps(view, ensure_ascii=False, separators=(",", ":"), sort_keys=True)]))
    roll = perfect["rollup"].first()
    assert roll.exact_rate == roll.strict_rate == roll.legal_rate == 1.0
    assert tuple(perfect["signals"].first()) == (1.0, 0.0, 1.0)
    assert perfect["pairs"].first().pair_exact_accuracy == 1.0 and perfect["pairs"].first().complete_pairs == 10

    def chatty():
        return lambda view: '{"action":"rest"}\nuser\n{"another":"turn"}' if view["self"]["energy"] % 2 else 1 / 0

    loose = P.evaluation(P.predict(records, chatty))
    roll = loose["rollup"].first()
    assert roll.n_strict == 0 and 0 < roll.n_parsed < roll.records
    assert loose["macro"].first().macro_accuracy == pytest.approx(loose["recall"].agg(F.avg("recall")).first()[0], abs=1e-4)


def test_digests_of_large_files(spark, tmp_path):
    """A file over the limit is streamed, with the same digest."""
    import hashlib

    from tidemill.sources.records_io import file_digests

    texts = {f"f{i}.bin": bytes(range(256)) * (i + 1) for i in range(4)}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    want = {name: hashlib.sha256(data).hexdigest().upper() for name, data in texts.items()}
    for whole in (1 << 20, 600, 1):
        assert {r.path.split("/")[-1]: r.sha256 for r in file_digests(spark, str(tmp_path), whole).collect()} == want
