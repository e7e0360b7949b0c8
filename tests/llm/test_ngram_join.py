import random

import numpy as np
import pytest

from tablemend.llm import ngram_join as J

from .conftest import frame, odd_rows, words


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]))
    root = list(range(len(rows)))
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    members = {}
    for k, r in enumerate(root):
        members.setdefault(r, []).append(rows[k][0])
    least = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return sorted((str(rows[k][0]), str(least[root[k]]), links[k]) for k in range(len(rows))), len(members)


def told(found):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in found)


def test_odd_rows(odd):
    found = J.near_classes(odd).collect()
    expected, classes = brute(odd_rows())
    assert told(found) == expected
    assert sum(r.kept for r in found) == classes


@pytest.mark.parametrize("members", [4, 64])
def test_large_groups_in_parts(spark, monkeypatch, members):
    monkeypatch.setattr(J, "MEMBERS", members)
    rng = random.Random(9)
    base = words(rng, 150).split()
    rows = []
    for i in range(90):
        changed = list(base)
        for _ in range(rng.randint(0, 3)):
            changed[rng.randrange(len(base))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(changed)))
    rows += [(1000 + i, words(rng, 60)) for i in range(40)] + [(2000 + i, rows[3][1]) for i in range(20)]
    found = told(J.near_classes(frame(spark, rows)).collect())
    expected, _ = brute(rows)
    lost = sum(abs(a[2] - b[2]) for a, b in zip(found, expected, strict=True))
    assert lost <= 0.01 * sum(e[2] for e in expected)
    assert [f[:2] for f in found] == [e[:2] for e in expected]


def test_one_of_each_keeps_columns(odd, none):
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == brute(odd_rows())[1]
    assert J.one_of_each(none).count() == 0 and J.near_classes(none).count() == 0


def test_prefix_depth_reaches_recall():
    assert 1 - (1 - 0.8 ** J.depth()) ** J.TREES >= J.RECALL
    assert 1 - (1 - 0.8 ** (J.depth() + 1)) ** J.TREES < J.RECALL


def test_prefixes_are_shortened_as_far_as_links_ask():
    none = [0] * J.BANDS
    close = [0] * (J.BANDS - 2) + [4000, 9000]
    assert J.shortened(none, J.LONGEST) == J.depth()  # nothing is known: as the threshold asks
    assert J.shortened([0] * (J.BANDS - 1) + [5], J.LONGEST) == J.depth()  # too few to tell
    assert J.shortened(close, J.LONGEST) == J.LONGEST  # weaker links would have shown
    assert J.shortened([1, *close[1:]], J.LONGEST) == J.depth()
    for band in range(J.BANDS):
        seen = [0] * band + [10**6] * (J.BANDS - band)
        edge = 0.8 + 0.2 * band / J.BANDS
        assert J.chance(edge, J.shortened(seen, J.LONGEST)) >= J.RECALL
        assert J.shortened(seen, 5) <= 5


def test_labels_sort_and_prefixes_number():
    rng = random.Random(2)
    hashes, begin = J.shingles([words(rng, 30) for _ in range(20)] + [words(random.Random(3), 30)] * 2)
    found = J.labels(hashes, begin)
    raw = [row[0].tobytes() for row in found]
    assert sorted(range(22), key=lambda i: raw[i]) == sorted(range(22), key=lambda i: found[i, 0].tolist())
    for length in (1, 4, J.LONGEST):
        number = J.prefixes(found, length)
        for a in range(22):
            for b in range(22):
                assert (number[a] == number[b]).tolist() == [x[:length].tolist() == y[:length].tolist() for x, y in zip(found[a], found[b], strict=True)]


def test_forest_descends_only_where_links_are_weak(spark):
    """Close copies alone stop at whole labels; with weak links shorter prefixes follow; no link is counted twice."""
    rng = random.Random(4)

    def spread(base, changes):
        changed = list(base)
        for at in rng.sample(range(len(base)), changes):
            changed[at] = f"x{rng.randrange(10**6)}"
        return " ".join(changed)

    close = [(10 * g + i, spread(base, i % 2)) for g in range(30) for base in [words(rng, 400).split()] for i in range(9)]
    weak = [(5000 + 10 * g + i, spread(base, i)) for g in range(20) for base in [words(rng, 150).split()] for i in range(4)]
    for rows, expected in ((close, [J.LONGEST]), (close + weak, [J.LONGEST, J.depth()])):
        blocks = J.to_blocks(frame(spark, rows))
        signed = J._signed(blocks, J.field_of(frame(spark, rows), "doc_id"))
        sets = signed.groupBy("set_a", "set_b").agg(J.F.min("key").alias("key"), J.F.count("*").alias("weight"))
        reps = J.saved(signed.select("key", "labels").join(sets.select("key", "weight"), "key"), "reps")
        _, tried = J.linked(blocks, reps)
        assert [tried[0], tried[-1]] == [expected[0], expected[-1]]
        found = told(J.near_classes(frame(spark, rows)).collect())
        wanted, _ = brute(rows)
        assert all(a[2] <= b[2] for a, b in zip(found, wanted, strict=True))
        assert sum(b[2] - a[2] for a, b in zip(found, wanted, strict=True)) <= 0.005 * sum(b[2] for b in wanted)


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 25)).astype(np.uint64) for _ in range(12)]
    assert J.overlaps(sets).tolist() == [
        [len(np.intersect1d(a, b)) if i != j else sum(any(x in s for k, s in enumerate(sets) if k != i) for x in a) for j, b in enumerate(sets)]
        for i, a in enumerate(sets)
    ]


def test_connected_chain(spark):
    chain = [(i + 1, i) for i in range(40)] + [(101, 100), (5, 5)]
    found = {r["key"]: r["least"] for r in J.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i + 1: 0 for i in range(40)}, 101: 100}
