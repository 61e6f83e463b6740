"""Benchmark passages of every length inside documents, by brute force."""

import random

from tidemill.queries import QUERIES


def test_every_short_passage_is_searched(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5)))
    docs = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["", "é ñ", "a  b", None]
    items = [f"absent passage {i}" for i in range(1100)]  # more short passages than any bound
    for n in range(1, 11):
        for _ in range(12):
            text = rng.choice(docs[:60])
            w = text.split(" ")
            i = rng.randrange(len(w))
            cut = " ".join(w[i : i + n])
            items += [cut, cut[1:] or cut, cut[:-1] or cut]
    items += ["", " ", "é", "a  b", "  ", None]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in QUERIES["contamination_passage"](spark, str(tmp_path)).collect())
    want = sorted((i, j) for i, d in enumerate(docs) for j, p in enumerate(items) if d is not None and p is not None and p in d)
    assert len(got) == len(set(got)) and not set(got) ^ set(want)
