import math

import numpy as np
import pytest

from tablemend.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component int, whitened double, size int"


def table(spark, vectors, start=0):
    rows = [(start + i, v, 1, 2, 0.5, 7) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors, k=8):
    """Brute force by whole matrices, in Python integers where exactness is asked for."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    far = n * x - sums
    deviation = [int(sum(a * a for a in row)) for row in far]
    z = far.astype(float) / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > 1e-9 * values[0]).sum())) if values[0] > 0 else 0
    return n, deviation, z @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(spark, rows, vectors, ids, k=8):
    found = whitening.components(rows, k).collect()
    n, deviation, told, share = plain(vectors, k)
    assert len(found) == told.size
    if not found:
        return
    by = {(r.vec_id, r.component): r for r in found}
    mine = np.array([[by[i, c + 1].whitened for c in range(told.shape[1])] for i in ids])
    sign = np.sign((mine * told).sum(0))
    assert np.abs(mine * sign - told).max() < 1e-8
    for i, d in zip(ids, deviation):
        for c, s in enumerate(share):
            row = by[i, c + 1]
            assert row.deviation == d and row.n == n and abs(row.explained / s - 1) < 1e-9 and 0 <= row.identity_error < 1e-9
    assert len({r.identity_error for r in found}) == 1


def test_against_whole_matrices(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 20)) * np.linspace(0.2, 2, 20)).astype(np.float32).tolist()
    compare(spark, table(spark, vectors).repartition(7), vectors, range(300))
    compare(spark, table(spark, vectors), vectors, range(300), k=3)


def test_fewer_dimensions_and_ranks(spark):
    rng = np.random.default_rng(2)
    flat = (rng.integers(-3, 4, size=(80, 2)) @ rng.integers(-3, 4, size=(2, 6))).astype(float).tolist()  # rank 2 in 6
    compare(spark, table(spark, flat), flat, range(80))
    line = [[float(i), 1.0] for i in range(5)]
    compare(spark, table(spark, line), line, range(5))


def test_unusable_vectors_are_dropped(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 5)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [1.0, 2.0, float("inf"), 0.0, 0.0], [1.0, 2.0], [None] * 5]
    rows = table(spark, good).union(table(spark, odd, 100)).repartition(3)
    compare(spark, rows, good, range(40))


def test_copies_count_and_ids_may_repeat(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(30, 4)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 20
    compare(spark, table(spark, vectors), vectors, range(50))
    twice = table(spark, vectors).selectExpr("if(vec_id < 2, null, 7L) AS vec_id", "embedding")
    assert whitening.components(twice).count() == 200


def test_nothing_to_whiten(spark):
    assert whitening.components(table(spark, [])).count() == 0
    assert whitening.components(table(spark, [None, [float("nan")]])).count() == 0
    assert whitening.components(table(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.components(table(spark, [[1.0, 2.0]] * 9)).count() == 0


def test_too_large_entries_are_refused(spark):
    with pytest.raises(Exception, match="OverflowError"):
        whitening.components(table(spark, [[1e30, 1.0], [2.0, 3.0]])).count()


def test_factor_and_rotations():
    rng = np.random.default_rng(5)
    for d, rank in ((1, 1), (6, 6), (9, 4), (33, 33)):
        x = rng.normal(size=(100, rank)) @ rng.normal(size=(rank, d)) * np.logspace(0, 3, d)
        v = x.T @ x / 100
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v, rtol=1e-10, atol=1e-10 * v.max())
        axes, values = whitening.jacobi(factor)
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12) and (np.diff(values) <= 0).all()
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
