import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tablemend.llm import piece_bpe

from .conftest import odd_rows

MODEL = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(text, group=piece_bpe.GROUP):
    return piece_bpe.texts_ids([text], piece_bpe.vocabulary(MODEL), group)[0].tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("theinonr ▁▁  \n\té漢😀xx==1<0A>"), max_size=120), st.sampled_from([5, 40, 1 << 18]))
def test_ids_are_those_of_the_library(text, group):
    assert ids(text, group) == LIBRARY.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_characters(text):
    assert ids(text) == LIBRARY.encode(text)


@pytest.mark.parametrize("long", [3, 256, 10**9])
def test_runs_and_words_without_spaces(monkeypatch, long):
    """Rounds and heap merge alike, also where equal scores make the leftmost pair grow."""
    monkeypatch.setattr(piece_bpe, "LONG", long)
    noise = base64.b64encode(random.Random(2).randbytes(900)).decode()
    for text in [" " * 300, "a" * 500, "=" * 77 + " " * 50 + "x", noise, "theinthein" * 40, "漢" * 300, "\x00" * 20, "é" * 99 + "▁" * 40]:
        assert ids(text) == LIBRARY.encode(text)


def test_words_of_one_hash_are_compared():
    """A hash that says too little costs time, not correctness."""
    points = np.array([ord(c) for c in "abcabdabcxabd"], np.uint32)
    starts, sizes = np.array([0, 3, 6, 9, 10]), np.array([3, 3, 3, 1, 3])
    mix = piece_bpe.mix
    try:
        piece_bpe.mix = lambda x: np.zeros_like(x)
        first, like = piece_bpe.distinct(points, starts, sizes)
    finally:
        piece_bpe.mix = mix
    for word, at in enumerate(first[like]):
        assert sizes[at] == sizes[word]
        assert points[starts[at] : starts[at] + sizes[at]].tolist() == points[starts[word] : starts[word] + sizes[word]].tolist()


def test_odd_rows_and_decoding(odd):
    found = piece_bpe.decode(piece_bpe.encode(odd, MODEL), MODEL).collect()
    want = [(str(i), LIBRARY.encode(t or "")) for i, t in odd_rows()]
    assert sorted((str(r.doc_id), list(r.ids)) for r in found) == sorted(want)
    assert all(r.n_tokens == len(r.ids) and r.decoded == LIBRARY.decode(list(r.ids)) for r in found)


def test_empty_table(none):
    assert piece_bpe.decode(piece_bpe.encode(none, MODEL), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.pieces[500].type = proto.ModelProto.SentencePiece.USER_DEFINED
    path = tmp_path / "own.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        piece_bpe.vocabulary(str(path))
