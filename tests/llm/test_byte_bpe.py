import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tablemend.llm import byte_bpe

from .conftest import odd_rows

RANKS = P.path("byte_bpe_50k.tiktoken")
PLAIN = tiktoken.Encoding(
    "plain",
    pat_str=P.PATTERN,
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))},
    special_tokens={},
)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 é\n\t\x1c\x85\xa0'sß😀.,"), max_size=80), st.integers(1, 20))
def test_pieces_give_the_ids_of_the_whole(text, piece):
    assert "".join(byte_bpe.safe_pieces(text, piece)) == text
    assert byte_bpe.text_ids(text, byte_bpe.encoding(RANKS, P.PATTERN), piece).tolist() == PLAIN.encode_ordinary(text)


def test_round_trip_of_odd_rows(odd):
    found = byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    expected = sorted((str(i), hashlib.sha256(np.array(PLAIN.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), (t or "").encode()) for i, t in odd_rows())
    assert sorted((str(r.doc_id), hashlib.sha256(r.ids).hexdigest(), bytes(r.decoded)) for r in found) == expected
    assert all(r.n_tokens * 4 == len(r.ids) for r in found)


def test_empty_table(none):
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0
