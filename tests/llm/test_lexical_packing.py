import collections
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablemend.llm import lexical_packing as L

from .conftest import frame, odd_rows

PATH = P.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


def whole(text):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 é\n\t\x1c\x85\xa0'sß😀.,"), max_size=60))
def test_pieces_give_the_ids_of_the_whole(text):
    assert "".join(L.pieces(text)) == text
    assert L.encoded([text], PATH) == [whole(text)]


def test_full_cache_learns_no_more():
    L._spaced.clear()
    L._plain.clear()
    texts = ["a b, c d e. f", "g h i!", "a b, c d e. f"]
    for _ in range(2):
        assert L.encoded(texts, PATH, cache=3) == [whole(t) for t in texts]
        assert len(L._spaced) == 3


def checked(rows, found):
    """Every id of every document lies in one piece, sequences have no gap and no padding."""
    ids = collections.Counter()
    for i, t in rows:
        ids[str(i), whole(t)] += 1
    by_id = collections.defaultdict(list)
    for (i, b), n in ids.items():
        by_id[i] += [b] * n
    tokens = collections.defaultdict(int)
    sequences = collections.defaultdict(list)
    for r in found:
        assert any(
            len(b) == 4 * r.doc_tokens and zlib.crc32(b[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
            for b in by_id[str(r.doc_id)]
        )
        tokens[str(r.doc_id)] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert tokens == {i: sum(len(b) // 4 for b in own) for i, own in by_id.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0


@pytest.mark.parametrize("index_rows", [5, 2048])
def test_odd_rows(odd, none, monkeypatch, index_rows):
    monkeypatch.setattr(L, "INDEX_ROWS", index_rows)
    checked(odd_rows(), L.pack(odd, PATH).collect())
    assert L.pack(none, PATH).count() == 0


def test_neighbours_share_words():
    texts = ["red apple pie", "blue sky", "apple pie crust", "green grass", "sky blue deep", "grass is green"]
    idf = np.ones(L.SLOTS)
    found = list(L.order(texts, [100] * 6, idf, 3.0, 210))
    assert sorted(found) == list(range(6)) and found[:2] == [0, 2]
    index = L.Index(texts, idf, 3.0)
    index.unused[1] = False
    assert index.nearest(1).tolist() == [4]


def test_index_ranks_as_bm25():
    texts = ["a b c d", "a b", "a a a x", "q r", "b c d z"]
    idf = np.linspace(0.5, 2, L.SLOTS)
    index = L.Index(texts, idf, 3.2)
    doc, slot, times, words = L._terms(texts)

    def score(seed, other):
        total = 0.0
        for s in slot[doc == seed]:
            hit = (doc == other) & (slot == s)
            if hit.any():
                n = times[hit][0]
                total += idf[s] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * words[other] / 3.2))
        return total

    scores = [(score(0, k), -k) for k in range(1, 5) if score(0, k) > 0]
    index.unused[0] = False
    assert index.nearest(0).tolist() == [-k for _, k in sorted(scores, reverse=True)]


def test_routes_follow_shared_telling_words():
    idf = np.full(L.SLOTS, 1e-6)
    telling = L._terms(["zebra"])[1][0]
    idf[telling] = 10.0
    routes = L._routes(["the zebra ran", "a zebra sat", "the cat ran", None, ""], idf)
    assert routes[0] == routes[1] != routes[2] and np.isinf(routes[3:]).all()


def test_tail_is_cut_into_powers_of_two():
    assert L.tail(1023) == [512, 256, 128, 64, 32, 16, 8, 4, 2, 1] and L.tail(8) == [8] and L.tail(0) == []


def test_every_word_of_a_seed_is_looked_up():
    heavy = " ".join(f"h{i}" for i in range(20))
    texts = [f"{heavy} last", "last other", *[f"h{i} own{i}" for i in range(20)]]
    idf = np.full(L.SLOTS, 5.0)
    idf[L._terms(["last"])[1][0]] = 0.01
    index = L.Index(texts, idf, 3.0)
    index.unused[0] = False
    assert sorted(index.nearest(0).tolist()) == list(range(1, 22))


def test_pieces_of_a_shard_are_one_index():
    texts = ["zebra one", *[f"filler{i}" for i in range(30)], "zebra two"]
    words = np.unique(L.word_hashes(b"zebra")[0])
    index = L.Index([], np.ones(1), 2.0, words)
    for text in texts:
        index.add([text])
    index.build()
    index.unused[0] = False
    assert index.nearest(0).tolist() == [31]


def test_frequencies_are_counted_by_word_over_all_shards(spark):
    rows = [(i, f"common w{i % 7} only{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, __text string").repartition(4)
    found = L.frequencies(L._sharded(docs)).collect()
    hashes = {int(L.word_hashes(w.encode())[0].view(np.int64)[0]): w for w in ["common", *[f"w{i}" for i in range(7)]]}
    assert found and all(r["__df"] == sum(hashes[r["__word"]] in t.split() for _, t in rows) for r in found)
    assert {hashes[r["__word"]] for r in found} >= {"common"}


def test_workers_forget_the_caches_of_other_operators():
    from tablemend.llm import common
    from tablemend.llm import lexical_packing as P

    P._spaced["word"] = b"1234"
    common.forget_others(P.__name__)
    assert P._spaced
    assert list(common.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert not P._spaced and not P._plain


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abthe1 é\n\t\x1c\x85\xa0'sß😀.,<|endoftext|>中"), max_size=80))
def test_ranks_give_the_ids_of_the_library(text):
    assert L._codec(PATH) is not None
    assert L.ids_of([text, None], PATH) == [whole(text), whole(None)]


def test_more_blanks_than_the_pattern_goes_back_over():
    text = "a" + " " * 1_500_000 + "b"
    assert L.ids_of([text], PATH) == [whole(text)]


def test_other_tokenizers_keep_their_own_splitting(tmp_path):
    import json

    told = json.load(open(PATH, encoding="utf-8"))
    told["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(told), encoding="utf-8")
    assert L._codec(str(tmp_path / "other.json")) is None


def test_used_documents_leave_the_postings():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.4, 40) if w < 500) for _ in range(400)]
    words, n = np.unique(np.concatenate([np.unique(L.word_hashes(t.encode())[0]) for t in texts]), return_counts=True)
    index, whole_index = (L.Index([], L._weights(n, 400), 40.0, words) for _ in range(2))
    for one in (index, whole_index):
        one.add(texts)
        one.build()
    whole_index._dropped = lambda: None
    sizes = [300 + 7 * (k % 90) for k in range(400)]
    found = list(L.walk(index, sizes, 1024))
    assert found == list(L.walk(whole_index, sizes, 1024)) and sorted(found) == list(range(400))
    assert len(index.doc) < len(whole_index.doc) // 2


def test_shards_follow_bytes_not_the_order_of_routes(spark):
    rows = [(i, f"zebra own{i} " + "x " * (2000 if i % 10 == 0 else 20)) for i in range(400)]
    rows += [(i, "many copies of one text " * 40) for i in range(400, 600)] + [(i, None) for i in range(600, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    frequency, n, _, chars = L.statistics(docs)
    idf = spark.sparkContext.broadcast(np.where(L._weights(frequency, n) > 0, 1e-9, 0))
    idf.value[L._terms(["zebra"])[1][0]] = 10.0
    shares = spark.sparkContext.broadcast(L._shares(docs, "text", idf, 8, chars, n))
    dealt = L._dealt(docs, "doc_id", "text", idf, shares).collect()
    tables = [(r["__shard"], L.unpacked(r["__data"])) for r in dealt]
    found = [(s, i, t) for s, table in tables for i, t in zip(*(table.column(c).to_pylist() for c in ("__id", "__text")), strict=True)]
    assert sorted(i for _, i, _ in found) == list(range(700)) and {i: t for _, i, t in found} == dict(rows)
    size = collections.Counter()
    for s, _, t in found:
        size[s] += len(t or "") + L.ROW_BYTES
    assert max(size.values()) < 2 * sum(size.values()) / 8


def test_shards_hold_equal_routes_together():
    shares = L.Shares(50, {}, {}, 1 << 20)
    found = shares.of([0.25, 0.25, np.inf, 0.5], [1, 2, 3, 4], [5, 6, 7, 8])
    assert found[0] == found[1] and all(0 <= s < 50 for s in found)
