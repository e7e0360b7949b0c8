"""Cycle lengths: signatures compared by codes, repetitions counted where they lie, scores made once."""

import random

import pytest
from pyspark.sql import functions as F

from tablemend.functions import rows as R
from tablemend.operators import blocks as B, structure as S
from tablemend.operators.boundaries import ScoredRule


def likeness(a, b):
    if a == b:
        return 1.0
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b)) if a and b else 0.0


def words(rng, n, longest):
    return ["".join(rng.choice("EDNTM") for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_codes_compare_as_texts(spark):
    rng = random.Random(3)
    texts = ["", "T", "E" * 60, "T" * 60, "T" * 61, *words(rng, 12, 8), *words(rng, 12, 140)]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    code = lambda name: R.signature_code(F.col(name)).alias(name + "_code")
    coded = df.select("a", "b", code("a"), code("b"))
    got = coded.select("a", "b", R.code_similarity(F.col("a_code"), F.col("b_code")).alias("s")).collect()
    assert {(r["a"], r["b"]): r["s"] for r in got} == pytest.approx({(a, b): likeness(a, b) for a, b in pairs})


def plain_scores(sigs):
    out, n = {}, len(sigs)
    filled = lambda s: len(s.replace("E", ""))
    for c in range(2, min(12, n // 2) + 1):
        blocks = [sigs[i : i + c] for i in range(0, n - c + 1, c)]
        pairs = [list(zip(b, sigs[:c])) for b in blocks]
        match = [sum(likeness(a, t) for a, t in p) / c >= 0.72 - 1e-12 for p in pairs]
        width = [all(abs(filled(a) - filled(t)) <= 1 for a, t in p) for p in pairs]
        steps = [[likeness(sigs[i], sigs[i + c]) for i in range(r, n - c, c)] for r in range(c)]
        out[c] = (sum(match) / len(match), sum(width) / len(width), sum(sum(s) / len(s) for s in steps) / c)
    return out


@pytest.mark.parametrize("size", [13, 16, 1 << 16])
def test_cycle_scores_do_not_depend_on_blocks(spark, size):
    rng = random.Random(8)
    files = {"a": [rng.choice(["TT", "EEN", "EEND", "T"]) for _ in range(70)], "b": ["NT", "TTT"] * 20, "c": words(rng, 29, 90), "d": ["T"] * 4, "e": ["T"] * 3}
    rows = [(f, j, len(sigs), s) for f, sigs in files.items() for j, s in enumerate(sigs)]
    df = spark.createDataFrame(rows, "file_id string, j long, n_data long, sig string").repartition(5)
    found = S.cycle_scores(df, size).collect()
    want = {(f, c): v for f, sigs in files.items() if len(sigs) >= 4 for c, v in plain_scores(sigs).items()}
    got = {(r["file_id"], r["cycle"]): (r["signature_repeat"], r["width_repeat"], r["cyclic_sim"]) for r in found}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_best_cycles_are_scored_once(spark):
    rows = [("a", j, 40, ["TT", "NN"][j % 2]) for j in range(40)]
    data = spark.createDataFrame(rows, "file_id string, j long, n_data long, sig string")
    profile = spark.createDataFrame([("a", 0.5)], "file_id string, segmentation_likelihood double")
    best = S.best_cycle(data, profile)
    # scores are read from a table: they decide which files are searched for patterns, and stand in the result
    assert "nearby" not in best._jdf.queryExecution().analyzed().toString()
    assert [(r["cycle"], r["score"]) for r in best.collect()] == [(2, 1.0)]


def test_replay_notes_states_not_outcomes(spark):
    """What a fold carries is copied with every row, so outcomes of a long block must not be carried through it."""
    n = 3000
    rows = [("a", j, 2, "10" if j % 2 == 0 else "01", j % 2, j % 2 == 0) for j in range(n)]
    df = spark.createDataFrame(rows, "file_id string, j long, span int, fits string, best int, anchor boolean")
    folded = B.fold_blocks(df, ["file_id"], "j", ScoredRule())
    longest = max(len(chunk) for chunk in spark.range(1).select(B.chunks(F.array_repeat(F.lit(1), n)).alias("c")).head()["c"])
    assert longest <= 64
    got = {r["j"]: (r["record_id"], r["offset"]) for r in folded.collect()}
    assert got == {j: (j // 2, j % 2) for j in range(n)}
