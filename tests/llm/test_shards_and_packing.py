import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tests.llm.conftest import edge_texts
from tidemill.llm.config_packing import best_fit, cuts, encoder, knapsack, pack, plan
from tidemill.llm.hilbert_shard import hilbert, hilbert_shards, write_shards


@pytest.mark.parametrize("bits, dims", [(2, 3), (3, 2), (4, 3)])
def test_curve_steps_to_neighbours(bits, dims):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    h = hilbert(cells, bits)
    assert sorted(h) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(1) == 1).all()


def test_shards(spark, edge_docs, no_docs, tmp_path):
    rows = hilbert_shards(edge_docs).collect()
    texts = Counter((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in edge_docs.collect())
    assert Counter((str(r.row.doc_id), r["size"], r.text_crc32) for r in rows) == texts
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert hilbert_shards(no_docs).count() == 0
    docs = edge_docs.withColumns({c: F.lit(c) for c in ("shard", "slot", "_id", "_shard", "curve")})
    assert write_shards(docs, str(tmp_path / "out")) == "shard_"
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(str, back.select(docs.columns).collect())) == Counter(map(str, docs.collect()))


def test_files_have_narrow_ranges(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    write_shards(docs, str(tmp_path / "out"))
    per_file = spark.read.parquet(str(tmp_path / "out")).groupBy(F.input_file_name()).agg(F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources")).collect()
    langs, sources = docs.select("lang").distinct().count(), docs.select("source").distinct().count()
    assert len(per_file) >= 16
    assert sum(r.langs for r in per_file) <= 0.5 * langs * len(per_file) and sum(r.sources for r in per_file) <= 0.5 * sources * len(per_file)


def test_pieces(spark, edge_docs, no_docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    args = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    special = edge_docs.limit(0).union(edge_docs.where("doc_id = 3").selectExpr("100 doc_id", "'a <|endoftext|> b' text", *edge_docs.columns[2:]))
    docs = edge_docs.union(special)
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        for i, (a, b) in enumerate(cuts(len(ids), 64)):
            want[str(r.doc_id), i, a, b - a, np.array(ids[a:b], "<u4").tobytes()] += 1
    rows = pack(docs, *args, capacity=64).collect()
    assert Counter((str(r.row.doc_id), r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(no_docs, *args).count() == 0


def test_cuts():
    assert cuts(3, 4) == [(0, 3)] and cuts(4, 4) == [(0, 4)] and cuts(9, 4) == [(0, 1), (1, 5), (5, 9)] and cuts(8, 4) == [(0, 4), (4, 8)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=25))
def test_plan_holds_every_piece_once(histogram):
    segments, used = plan(histogram, 50)
    fill, places = Counter(), set()
    for size, parts in segments.items():
        bounds = [p[0] for p in parts] + [histogram[size]]
        assert bounds[0] == 0 and bounds == sorted(bounds)
        for (first, sequence, each, base), end in zip(parts, bounds[1:], strict=True):
            for k in range(end - first):
                at = (sequence + k // each, base + k % each * size)
                assert at not in places
                places.add(at)
                fill[at[0]] += size
    total = sum(k * v for k, v in histogram.items())
    assert max(fill.values()) <= 50 and len(fill) == used and sum(fill.values()) == total
    sizes = np.array(sorted(histogram))
    assert used <= sum(n for _, n in best_fit(sizes, np.array([histogram[s] for s in sizes]), 50))


def test_plan_of_few_pieces():
    assert plan({7: 8, 10: 1, 28: 17, 23: 8, 1: 1, 3: 1, 20: 13}, 50)[1] <= 21


def test_plan_is_near_its_bound():
    """Of many pieces the program leaves next to no room."""
    rng = np.random.default_rng(5)
    histogram = Counter(np.minimum(1024, rng.lognormal(5.5, 1.0, 20000).astype(int) + 2).tolist())
    total = sum(k * v for k, v in histogram.items())
    assert plan(histogram)[1] <= -(-total // 1024) * 1.002 + 1


def test_ids_are_those_of_the_library():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>  x<|endoftext", "é漢\u0301 \t\n don't 123,456", "  ", *(r for r in edge_texts() if r)]
    for text in texts:
        assert made.encode(text, allowed_special="all") == tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.floats(0.1, 5), st.integers(1, 4)), min_size=1, max_size=4, unique_by=lambda x: x[0]))
def test_knapsack_is_best(items):
    sizes, prices, most = (np.array(x) for x in zip(*items, strict=True))
    got = knapsack(sizes, prices, most, 20)
    value = sum(prices[i] * n for i, n in got.items())
    best = max(sum(p * n for p, n in zip(prices, c, strict=True)) for c in itertools.product(*[range(m + 1) for m in most]) if sum(s * n for s, n in zip(sizes, c, strict=True)) <= 20)
    assert all(n <= most[i] for i, n in got.items()) and abs(value - best) < 1e-9
