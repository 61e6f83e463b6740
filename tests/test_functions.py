import pytest
from pyspark.sql import functions as F

from tidemill.functions import actions as A
from tidemill.functions import geometry as G
from tidemill.functions import records as R
from tidemill.functions import text as X


@pytest.mark.parametrize(
    "text, strict, lenient",
    [
        ('{"action":"rest"}', "rest", "rest"),
        ('{"action":"rest"}\nuser\n{"another":"turn"}', None, "rest"),
        ('Action follows: {"action":"rest"}', None, "rest"),
        ('```json\n{"action":"forage"}\n```', None, "forage"),
        ('{"action":"move","target":[2,3]}', "move", "move"),
        ('{"action":"move","target":[2,true]}', None, None),
        ('{"action":"move","target":[2,1.0]}', None, None),
        ('{"action":"move","target":[1,2,3]}', None, None),
        ('{"action":"share","target":"other","amount":0}', None, None),
        ('{"action":"share","target":7,"amount":1}', None, None),
        ('{"action":"share","target":"o","amount":true}', None, None),
        ('{"action":"signal","message":"  "}', None, None),
        ('{"action":"rest","action":"forage"}', "forage", "forage"),
        ('{"action":"rest","x":NaN}', "rest", "rest"),
        ("[1]", None, None),
        ("nope {", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_parsers(text, strict, lenient):
    assert (A.strict(text) or {}).get("action") == strict
    assert (A.lenient(text) or {}).get("action") == lenient


def test_message_is_cut():
    assert len(A.strict('{"action":"signal","message":"' + "a" * 161 + '"}')["message"]) == 160


def test_legality(spark):
    rows = [("move", 2, 1, None, None), ("forage", None, None, None, None), ("reproduce", 2, 1, None, None), ("share", None, None, "other", 3), ("share", None, None, "other", 12), ("share", None, None, "far", 1), ("move", 0, 0, None, None), ("signal", None, None, None, None)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a struct<action:string,x:int,y:int,target:string,amount:int>")
    cells = F.array(F.struct(F.lit(2).alias("x"), F.lit(1).alias("y")))
    near = F.array(F.struct(F.lit("other").alias("id"), F.lit(1).alias("distance")), F.struct(F.lit("far").alias("id"), F.lit(2).alias("distance")))
    got = df.select("i", A.legality(F.col("a"), F.lit(12), F.lit(13), F.lit(0), cells, near).alias("l")).orderBy("i").collect()
    assert [r.l.reason for r in got] == ["legal", "no food", "below reproduction threshold", "legal", "insufficient energy", "target not adjacent", "target not open", "legal"]


def test_text(spark):
    df = spark.createDataFrame([("Food AT [ 4 , 2 ] x",), ("food at [4,2]",), ("none",), (None,)], "m string")
    got = df.select(X.coordinate(F.col("m")).alias("c"), X.strict_coordinate(F.col("m")).alias("s"), X.corrupt(F.col("m"), 7, 7).alias("k")).collect()
    assert [tuple(r.c) if r.c else None for r in got] == [(4, 2), (4, 2), None, None]
    assert [tuple(r.s) if r.s else None for r in got] == [None, (4, 2), None, None]
    assert [r.k for r in got] == ["food at [0,5] x", "food at [0,5]", "corrupted: none", None]
    blank = spark.createDataFrame([("\t a \n",), (" \n",), (None,)], "m string").select(X.normal_message(F.col("m")).alias("n")).collect()
    assert [r.n for r in blank] == ["a", None, None]


def test_geometry(spark):
    r = spark.range(1).select(G.neighbours(F.lit(0), F.lit(3), 4, 4).alias("n"), F.size(G.ball(F.lit(5), F.lit(5), 3, 24, 24)).alias("b"), G.clamp(F.lit(9), 1, 5).alias("c")).first()
    assert [tuple(c) for c in r.n] == [(1, 3), (0, 2)] and r.b == 25 and r.c == 5


def test_records(spark):
    df = spark.createDataFrame([([("system", "s"), ("user", '{"a":1}'), ("user", "b")],)], "prompt array<struct<role:string,content:string>>")
    r = df.select(R.last_user(F.col("prompt")).alias("l"), R.first_object_user(F.col("prompt")).alias("f"), R.inject_last_user(F.col("prompt"), lambda c: F.upper(c)).alias("i"), R.with_system(F.col("prompt"), F.lit("t")).alias("w")).first()
    assert (r.l, r.f, r.i[2].content, r.w[0].content) == ("b", '{"a":1}', "B", "t")
    with pytest.raises(Exception, match="system message"):
        df.select(R.with_system(F.slice("prompt", 2, 2), F.lit("t"))).collect()
