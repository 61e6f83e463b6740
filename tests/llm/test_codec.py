import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm.piece_codec import PieceModel, piece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aabet hin  \n\t▁éß漢🎉XY09.,!'"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encode_and_decode(both, text):
    ours, theirs = both
    ids, decoded = ours.round_trip(text)
    want = theirs.encode(text, add_eos=True)
    assert np.frombuffer(ids, "<i4").tolist() == want
    assert decoded == theirs.decode(want) == ours.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=12))
def test_decode_any_ids(both, ids):
    assert both[0].decode(ids) == both[1].decode(ids)


def test_cache_turns_over(both, monkeypatch):
    monkeypatch.setattr("tidemill.llm.piece_codec.CACHE_UNITS", 5)
    ours, theirs = PieceModel(PATH), both[1]
    text = " ".join(f"word{i % 13} other{i}" for i in range(60))
    assert np.frombuffer(ours.encode(text), "<i4").tolist() == theirs.encode(text, add_eos=True)


def test_operator(spark, edge_docs, no_docs, both):
    got = piece_codec(edge_docs, PATH)
    want = sorted((str(r.doc_id), len(i := both[1].encode(r.text or "", add_eos=True)), hashlib.sha256(str(i).encode()).hexdigest(), both[1].decode(i)) for r in edge_docs.select("doc_id", "text").collect())
    assert sorted((str(r.row.doc_id), len(r.ids), hashlib.sha256(str(list(r.ids)).encode()).hexdigest(), r.decoded) for r in got.collect()) == want
    assert piece_codec(no_docs, PATH).count() == 0
