"""The kept fingerprint index, and conversations as examples by a table function."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import corpus as C
from tidemill.operators.examples import conversation_examples, examples
from tidemill.operators.known import KnownFingerprints, bloom, maybe, merged


def fps(spark, numbers):
    return spark.createDataFrame([(i, None if i is None else f"fp-{i}") for i in numbers], "n long, fp string")


def test_index_knows_what_it_was_given(spark, tmp_path):
    index = KnownFingerprints(spark, str(tmp_path / "index"), bits=14, buckets=4)
    index.add(fps(spark, [*range(0, 600, 2), 4, 4, None]), "fp")
    asked = fps(spark, [*range(700), 5, 5, None, None])
    want = sorted([i for i in range(700) if i % 2 or i >= 600] + [5, 5])
    assert sorted(r.n for r in index.unknown(asked, "fp").where("n is not null").collect()) == want
    assert index.unknown(asked, "fp").where("n is null").count() == 2
    assert sorted(r.n for r in index.fresh(asked.where("n is not null"), "fp", ["n"]).dropDuplicates().collect()) == sorted(set(want))
    # the filter has no false negative, and tells most others
    new, open_ = index.split(asked, "fp")
    assert new.where("n % 2 = 0 and n < 600").isEmpty() and new.count() + open_.count() == 704
    false = open_.where("not (n % 2 = 0 and n < 600)").count()
    assert false / len(want) < 0.02
    # additions count at once, and in another opening of the folder
    index.add(fps(spark, range(1, 600, 2)), "fp")
    again = KnownFingerprints(spark, str(tmp_path / "index"), bits=14, buckets=4)
    for one in (index, again):
        assert sorted(r.n for r in one.unknown(fps(spark, range(610)), "fp").collect()) == list(range(600, 610))
        one.close()


def test_kept_fingerprints_are_not_moved(spark, tmp_path):
    """The candidates' exchange follows the buckets; there is none above the kept table."""
    index = KnownFingerprints(spark, str(tmp_path / "index"), buckets=8)
    index.add(fps(spark, range(2000)), "fp")
    plan = index.unknown(fps(spark, range(1500, 2500)), "fp")._jdf.queryExecution().executedPlan().toString()
    lines = plan[plan.index("SortMergeJoin") :].splitlines()
    (scan,) = [i for i, x in enumerate(lines) if "FileScan" in x and "known_" in x]
    assert "SelectedBucketsCount: 8 out of 8" in lines[scan]
    above = [x.lstrip("+-: *()0123456789").split()[0] for x in lines[scan - 2 : scan]]
    assert above == ["Sort", "Filter"]  # straight below the join
    assert [("8)" in x or ", 8," in x) for x in lines if "Exchange hashpartitioning(fp" in x] == [True]  # the candidates follow the buckets
    index.close()


def test_false_positives_are_few_and_filters_merge(spark):
    one, other = bloom(fps(spark, range(3000)), "fp", 16), bloom(fps(spark, range(3000, 5000)), "fp", 16)
    both = merged(one, other)
    assert both.first().words == bloom(fps(spark, range(5000)), "fp", 16).first().words
    asked = fps(spark, range(25_000)).crossJoin(F.broadcast(both)).withColumn("hit", maybe(F.col("fp"), F.col("words"), 16))
    counted = asked.agg(F.count_if((F.col("n") < 5000) & ~F.col("hit")), F.count_if((F.col("n") >= 5000) & F.col("hit"))).first()
    # (1 - exp(-4 * 5000 / 65536)) ** 4 is 0.48 %
    assert counted[0] == 0 and counted[1] / 20_000 < 0.01


def test_first_occurrence_with_nulls(spark):
    rows = [(1, "a", None), (2, "a", 1), (3, None, 2), (4, None, 1), (5, "b", 3)]
    df = spark.createDataFrame(rows, "i int, fp string, o int")
    assert sorted(r.i for r in C.first_occurrence(df, ["fp"], ["o"]).collect()) == [1, 4, 5]


def by_hand(rows, context):
    out, talks = [], {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        held, step = talks.setdefault(conv, ([], [0]))
        if role == "assistant":
            some = held[-context:]
            out.append((str(conv), turn, step[0], len(some), "\n".join(some), text or ""))
            step[0] += 1
        held.append(f"{role}: {text or ''}")
    return sorted(out)


def test_examples(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["hello", None, "", "two\nlines", "é漢"])) for c in [*range(12), None] for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(3000)]  # one very long conversation
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("other", F.lit(1)).repartition(5)
    for context in (1, 3, 50):
        assert sorted((str(r.conv_id), *list(r)[1:]) for r in examples(df, context).collect()) == by_hand(rows, context)
    assert examples(df.limit(0)).count() == 0


def test_examples_from_sql(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "c")], "conv_id int, turn int, role string, text string")
    df.createOrReplaceTempView("talks")
    spark.udtf.register("conversation_examples", conversation_examples())
    got = spark.sql("SELECT conv_id, context, answer FROM conversation_examples(TABLE(talks), context => 2) ORDER BY conv_id").collect()
    assert [tuple(r) for r in got] == [(1, "user: a", "b"), (2, "", "c")]
    for call, told in (("TABLE(SELECT 1 AS conv_id)", "lacks"), ("TABLE(talks), context => 0", "at least 1")):
        with pytest.raises(Exception, match=told):
            spark.sql(f"SELECT * FROM conversation_examples({call})").collect()
