"""Native parsing: strict actions against Python's json, event payloads as VARIANT."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import actions as A
from tidemill.functions import records as R
from tidemill.functions import text as X
from tidemill.operators import worlds as W
from tidemill.operators.payload import decoded, shredded
from tidemill.plans import reports
from tidemill.queries import QUERIES

KINDS = [*A.KINDS, "fly", "", 1, None, True, ["rest"]]
VALUES = [0, 1, -1, 3, 2**31 - 1, 2**31, -(2**31), 2**63, 10**30, 1.0, 2.5, True, False, None, "", "a", " x ", "organism-7", "1", [1, 2], [1, 2, 3], [1, None], [1, None, None], [True, 2], [1.0, 2], [], [[1, 2]], ["1", "2"], {"x": 1}, "  \x1c", "　hi\x85", "q" * 200, 'say "hi"\\ \n', "𝒳 é 漢"]


def texts():
    rng = random.Random(12)
    out = ["", " ", "null", "1", "[]", "{}", "{", "}", '"rest"', "rest", "﻿" + '{"action":"rest"}', '{"action":"rest"}\x00', '{"action":"rest","action":"fly"}', '{"action":"fly","action":"rest"}']
    out += ['{"action":"rest"},null] x', '{"action":"rest"}]', '{"action":"rest"},{"action":"rest"}', '{"action":"rest"}//', "{'action':'rest'}", "{action:\"rest\"}", '{"action":"rest",}', '{"action":"rest","n":NaN}', '{"action":"rest","n":-Infinity}']
    out += ['{"action":"rest","n":01}', '{"action":"rest","n":.5}', '{"action":"rest","n":1.}', '{"action":"rest","n":1e5}', '{"action":"rest","n":+1}', '{"action":"rest","n":"a\tb"}', '{"action":"\\u0072est"}', '{"action":"rest","n":"\\x"}', '{"action":"rest","n":{"a":1,"a":2}}']
    out += ['{"action":"move","target":[1,2],"target":[3,4]}', '{"action":"move","target":[-0,1e0]}', '{"action":"move","target":[-0,7]}', '{"action":"rest"}\n', '\t{"action":"rest"}\r', '{"action":"rest"} {"action":"rest"}', '{"action":"rest"}x', '[{"action":"rest"}]', '{"action":"rest","target":[1,{"b":1,"b":2}]}']
    for _ in range(3000):
        body = {k: rng.choice(VALUES) for k in ("target", "amount", "message", "other") if rng.random() < 0.5}
        items = [("action", rng.choice(KINDS)), *body.items()]
        rng.shuffle(items)
        text = json.dumps(dict(items), ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": "), (" ,\n", " :\t")]))
        if rng.random() < 0.4:  # one character added, lost or changed
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(['"', "{", "}", "[", "]", ",", ":", " ", "\\", "0", "-", "e", "n", "\x01"]) * rng.randint(0, 2) + text[at + rng.randint(0, 2) :]
        out.append(text)
    return [t for t in out if "\\ud" not in t.lower()]  # halves of surrogate pairs are no text


def test_strict_parser_takes_what_json_takes(spark):
    asked = texts()
    rows = spark.createDataFrame(list(enumerate(asked)) + [(-1, None)], "i int, t string").select("i", A.parse_strict(F.col("t")).alias("a")).collect()
    got = {r.i: r.a.asDict() if r.a and r.a.action else None for r in rows}
    wrong = [(t, got[i], A.strict(t)) for i, t in enumerate(asked) if got[i] != A.strict(t)]
    assert not wrong, wrong[:5]
    assert got[-1] is None and sum(x is not None for x in got.values()) > 300


def test_strict_parsing_has_no_python_node(spark, sf):
    plan = QUERIES["strict_json"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def tables(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_parse_a_row(spark, sf):
    """Each analysis of the log parses the payload in one place, however many fields it reads; a world's end rows are one place more."""
    log = reports.log(tables(spark, sf))
    log = log.select(*log.columns)
    scenes = reports.scenes(tables(spark, sf), "sender", "recipient")
    parses = lambda df: plan_of(df).count("parseJson") + plan_of(df).count("parse_json")
    for made in (W.decisions(log), W.messages(log), W.world_summary(log), W.communication_runs(log, scenes), W.rescue_runs(log, reports.scenes(tables(spark, sf), "donor", "child"))):
        assert parses(made) == 1
        assert "get_json_object(data" not in plan_of(made)
    assert parses(W.policy_comparison(log)) == 2
    told = plan_of(W.demonstrations(log))
    assert told.count("json_tuple(data") == 1 and "get_json_object(data" not in told and "parse" not in told.split("json_tuple")[0]


def test_shredded_log_gives_the_same(spark, sf, tmp_path):
    """A log written with its payload as VARIANT: equal results, and a scan that reads only the fields asked for."""
    log = reports.log(tables(spark, sf))
    shredded(log).write.parquet(str(tmp_path / "log"))
    kept = spark.read.parquet(str(tmp_path / "log"))
    scenes, pair = reports.scenes(tables(spark, sf), "sender", "recipient"), reports.scenes(tables(spark, sf), "donor", "child")
    shown = lambda df: sorted(map(str, df.collect()))
    for analysis in (W.decisions, lambda e: W.demonstrations(e).select("seed", "condition", "seq", "action"), W.messages, W.world_summary, W.policy_comparison, lambda e: W.communication_runs(e, scenes), lambda e: W.rescue_runs(e, pair)):
        assert shown(analysis(kept)) == shown(analysis(log))
    scan = W.messages(kept)._jdf.queryExecution().executedPlan().toString()
    assert "try_variant_get" not in scan.split("FileScan")[0] and "data:struct<" in scan


def test_fields_of_odd_payloads(spark):
    rows = [(1, '{"a":1,"b":{"y":2,"x":[1,"z"]}}'), (2, '{"a":"1"}'), (3, "no json"), (4, None), (5, '{"a":1,"a":2}'), (6, "[1]"), (7, '{"a":99999999999}'), (8, '{"a":null,"b":null}')]
    df = spark.createDataFrame(rows, "i int, data string")
    got = {r.i: (r.n, r.t) for r in decoded(df, {"n": ("a", "int"), "t": ("b", "string")}).collect()}
    assert got == {1: (1, '{"x":[1,"z"],"y":2}'), 2: (1, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None)}
    again = {r.i: (r.n, r.t) for r in decoded(shredded(df), {"n": ("a", "int"), "t": ("b", "string")}).collect()}
    assert again == got
    assert decoded(df.limit(0), {"n": ("a", "int")}).count() == 0


def observation(prompt):
    """The rule in plain Python: broken JSON raises, other values are passed over."""
    for m in prompt:
        if m[0] == "user" and isinstance(found := json.loads(m[1]), dict):
            return found
    raise ValueError("no object")


def test_first_object_is_found_by_parsing(spark):
    prompts = [
        [("system", "{}"), ("user", "[1]"), ("user", ' {"a":1} '), ("user", '{"b":2}')],
        [("user", '"{}"'), ("user", "3"), ("user", '{"a":{"b":1},"a":2}')],
        [("user", "null"), ("assistant", "{}")],
        [("user", "{not json"), ("user", "{}")],
        [("user", '{"a":1} x'), ("user", "{}")],
        [("user", '{"a":1}] x')],
        [("user", '{"a":1},{"b":2}')],
        [("user", '{"a":1},null] x')],
        [("user", "{'a':1}")],
        [],
    ]
    df = spark.createDataFrame(list(enumerate(prompts)), "i int, p array<struct<role:string,content:string>>")
    lenient = {r.i: r.c for r in df.select("i", R.first_object_user(F.col("p")).alias("c")).collect()}
    for i, prompt in enumerate(prompts):
        try:
            want = observation(prompt)
        except ValueError:
            with pytest.raises(Exception, match="no object|not JSON"):
                df.where(F.col("i") == i).select(R.first_object_user(F.col("p"), required=True)).collect()
            continue
        assert json.loads(lenient[i]) == want
        assert df.where(F.col("i") == i).select(R.first_object_user(F.col("p"), required=True)).first()[0] == lenient[i]
    assert lenient[2] is None and lenient[3] == "{}" and lenient[5] is lenient[6] is lenient[7] is lenient[8] is lenient[9] is None


def test_rebuilt_records_keep_their_metadata(spark):
    system = "new rules"
    prompt = [("system", "old"), ("user", "[0]"), ("user", '{"tick": 3,  "self": {"x": 1.0, "energy": 4}, "memory": []}'), ("user", '{"later": 1}')]
    rows = [(prompt, [("assistant", ' {"target": [1, 2],\n "action": "move", "why": "?"}')], "v4", 7)]
    kind = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame(rows, f"prompt {kind}, completion {kind}, curriculum string, pair int")
    got = R.rebuilt(df, F.lit(system)).first()
    assert [tuple(m) for m in got.prompt] == [("system", system), ("user", '{"memory":[],"self":{"energy":4,"x":1.0},"tick":3}')]
    assert [tuple(m) for m in got.completion] == [("assistant", '{"action":"move","target":[1,2]}')]
    assert (got.curriculum, got.pair) == ("v4", 7)
    for bad in ([("user", "no")], [("user", "[1]")]):
        with pytest.raises(Exception, match="no object|not JSON"):
            R.rebuilt(spark.createDataFrame([(bad, rows[0][1])], f"prompt {kind}, completion {kind}"), F.lit(system)).collect()
    with pytest.raises(Exception, match="no action"):
        R.rebuilt(spark.createDataFrame([(prompt, [("assistant", "rest")])], f"prompt {kind}, completion {kind}"), F.lit(system)).collect()


def test_canonical_json_is_that_of_python(spark):
    """Sorted keys, no spaces, other characters as they are, numbers as they stand."""
    rng = random.Random(1)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 5:
            return rng.choice([0, -3, 1.0, 0.5, 2.25, 10**12, True, None, "", "é漢", 'q"\\\n', "z", "12"])
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice("abcdefgh") + rng.choice(["", "é", "Z"]): value(depth - 1) for _ in range(rng.randint(0, 5))}

    made = [{"k": value(4), "a": value(3), "Z": value(2)} for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(m, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, m in enumerate(made)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.canonical_json(F.col("t")).alias("c")).collect()}
    assert got == {i: json.dumps(m, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for i, m in enumerate(made)}


@pytest.mark.parametrize("name", ["log_summaries", "log_communication_runs", "log_rescue_runs"])
def test_reports_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
