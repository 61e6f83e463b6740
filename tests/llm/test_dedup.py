"""Substring dedup (byte suffixes and word windows) against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm.bwt_dedup import leftmost_minimum, suffix_dedup
from tidemill.llm.cover_dedup import COVERS, cover_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_bytes(texts, size):
    seen = Counter(t[p : p + size] for t in texts for p in range(len(t) - size + 1))
    out = []
    for t in texts:
        step = np.zeros(len(t) + 1, int)
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                step[p] += 1
                step[p + size] -= 1
        drop = np.cumsum(step)[:-1] > 0
        spans = int((drop & ~np.r_[False, drop[:-1]]).sum()) if len(t) else 0
        out.append((len(t), int(drop.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~drop].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("size", [20, 60, 400])
def test_suffixes(spark, edge_docs, size):
    rows = edge_docs.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), *k) for r, k in zip(rows, kept_bytes([(r.text or "").encode() for r in rows], size), strict=True))
    done = suffix_dedup(edge_docs, min_bytes=size)
    got = sorted((str(r.row.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in done.collect())
    assert got == want
    for r in done.select("spans", "n_removed").collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def kept_words(rows, window):
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, {}
    for i, t in rows:
        words = WORD.findall(t or "")
        drop, own = [False] * len(words), []
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                drop[k : k + window] = [True] * window
            seen[key] = True
        del own
        out[i, t] = (len(words), sum(drop), hashlib.sha256(" ".join(w for w, d in zip(words, drop, strict=True) if not d).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [3, 8, 20])
def test_word_windows(spark, edge_docs, window):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    lone = [r for r in rows if r != (3, "same id, another text")]
    docs = edge_docs.where("text is null or text <> 'same id, another text'")
    want = kept_words(lone, window)
    for r in cover_dedup(docs, window=window).collect():
        texts = [t for i, t in lone if i == r.row.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) in [want[r.row.doc_id, t] for t in texts]


def test_same_id_other_text(spark, edge_docs):
    assert cover_dedup(edge_docs).count() == edge_docs.count()


def test_empty(spark, no_docs):
    assert suffix_dedup(no_docs).count() == cover_dedup(no_docs).count() == 0


def test_covers_align_any_two_positions():
    for v, members in COVERS.items():
        for shift in range(v):
            assert any((d + shift) % v in members for d in members)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=200), st.integers(1, 40))
def test_leftmost_minimum_depends_on_content_only(data, width):
    """Equal windows have their minimum at equal places, wherever they stand."""
    n = width + 7
    if len(data) < n:
        return
    whole = leftmost_minimum(np.frombuffer(data, np.uint8), width)
    for p in range(0, len(whole), 7):
        own = leftmost_minimum(np.frombuffer(data[p : p + n], np.uint8), width)
        assert own[0] == whole[p] - p


def test_suffix_dedup_equals_merged_transforms(spark):
    """op1's operator against repeated intervals from merging the transforms of shards, byte by byte."""
    import pyarrow as pa

    from tidemill.llm.interleave import repeated, shard
    from tidemill.llm.textvec import text_buffer

    rng = np.random.default_rng(4)
    passages = ["".join(rng.choice(list("abcdé "), 90)) for _ in range(4)]
    texts = ["".join(rng.choice(list("abcdé "), int(rng.integers(0, 200)))) + passages[k % 4] * (k % 3) + "".join(rng.choice(list("ab"), 60)) for k in range(60)] + ["", None, "x" * 300]
    for depth in (40, 100):
        parts = [texts[:20], texts[20:45], texts[45:]]
        buffers = [text_buffer(pa.array(p, pa.string())) for p in parts]
        found, _ = repeated([shard(b, o, depth) for b, o in buffers], [np.repeat(o[1:], np.diff(o)) - np.arange(len(b)) for b, o in buffers], depth)
        removed = []
        for (buf, offs), starts in zip(buffers, found, strict=True):
            drop = np.zeros(len(buf) + 1, np.int64)
            np.add.at(drop, starts, 1)
            np.add.at(drop, starts + depth, -1)
            gone = np.r_[0, np.cumsum(np.cumsum(drop[:-1]) > 0)]
            removed += (gone[offs[1:]] - gone[offs[:-1]]).tolist()
        got = suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_bytes=depth).select("row.doc_id", "n_removed").collect()
        assert sum(removed) > 0 and {r.doc_id: r.n_removed for r in got} == dict(enumerate(removed))
