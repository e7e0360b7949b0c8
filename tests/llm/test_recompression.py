import collections
import random

from tablemend.llm import recompression as R

from .conftest import frame, odd_rows, words


def brute(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        out.append((str(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def told(found):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found)


def test_odd_rows(odd, none):
    assert told(R.without_repeats(odd).collect()) == brute(odd_rows())
    assert R.without_repeats(none).count() == 0


def test_repeats_across_blocks(spark, monkeypatch):
    rng = random.Random(2)
    passages = [words(rng, n) for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(160):
        parts = [words(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), words(rng, rng.randint(0, 30))]
        if i % 17 == 0:
            parts.append("ab cd " * rng.randint(10, 60))
        if i % 19 == 0:
            parts.append("same " * rng.randint(10, 90))
        rows.append((i, " ".join(parts)))
    found = R.without_repeats(frame(spark, rows).repartition(7))
    assert told(found.collect()) == brute(rows)


def test_layout_stays_where_nothing_goes(odd):
    found = R.without_repeats(odd, others=("lang", "key"), as_is=True)
    rows = {(r.doc_id, r.kept) for r in found.collect() if not r.n_removed}
    assert (13, " lead  double \r\n tab\ttail ") in rows and (1, None) in rows


def test_word_hashes_at_chunk_borders(monkeypatch):
    from tablemend.llm import blocks

    text = (words(random.Random(4), 500) + " \t\n é\x0b").encode()
    whole = blocks.word_hashes(text)
    monkeypatch.setattr(blocks, "_CHUNK", 64)
    parts = blocks.word_hashes(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert len(whole[0]) == len(text.split())
