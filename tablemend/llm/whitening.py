"""Whitening of embeddings by their own principal components.

Entries become integers (``floor(scale * c) + shift``), so sums over any partitioning are exact. Tasks add up the scatter
of centred vectors; its d x d sum is all that reaches the driver, whatever the number of rows. There a pivoted Cholesky
factorisation gives a triangular factor of the covariance, and one-sided Jacobi rotations make the columns of that factor
orthogonal: their squared norms are the eigenvalues, and the normalised columns are the components.

Rows: a vector that is NULL, empty, or holds a NULL or non-finite entry is dropped. Where lengths differ, the commonest
length is the dimension (the longer of two equally common ones) and vectors of other lengths are dropped too. Repeated
rows and ids count each time; a NULL id is kept. Components without variance cannot be scaled and are left out, so equal
vectors, a single vector and an empty table give no rows. Entries beyond 2**42 and deviations beyond a long are refused with an error.
Only the id and vector columns are read. Memory of a task and of the driver is in proportion to d x d.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_of, lean, saved

SCALE, SHIFT = 1024, 100_000
#: largest entry that is told from its neighbours after scaling
LARGEST = float(1 << 42)
#: sweeps after which Jacobi rotations have settled by far
SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: count and sums of the integer vectors, unit components as columns, eigenvalues, total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of vectors without NULL or non-finite entries, their lengths, and the first entry of each."""
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = entries(column)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(sizes)
    rows = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    return rows, sizes[rows], (ends - sizes)[rows]


def entries(column: pa.Array) -> np.ndarray:
    """All entries of a batch of vectors as doubles, NULL as NaN; NULL vectors have none."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)


def integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and integer entries of the usable vectors of one length."""
    rows, sizes, starts = usable(column)
    fits = sizes == size
    values = entries(column)[starts[fits][:, None] + np.arange(size)]
    if values.size and np.abs(values).max() > LARGEST:
        raise OverflowError(f"an entry is beyond {LARGEST}")
    return rows[fits], np.floor(SCALE * values).astype(np.int64) + SHIFT


def scaled_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exactly: the whole part of the means is taken off before multiplying."""
    base = sums // n
    near = x - base
    if near.size and float(n) * (float(np.abs(near).max()) + 1) >= 2.0**62:
        raise OverflowError("too many rows for exact deviations of this range")
    return n * near - (sums - n * base)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Factor of a positive semidefinite matrix: columns by falling pivots, as many as its numerical rank."""
    d = len(a)
    factor = np.zeros((d, d))
    rest = a.diagonal().astype(float)
    least = d * np.finfo(float).eps * (rest.max() if d else 0)
    left = np.ones(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(left, rest, -np.inf)))
        if not rest[p] > least:
            return factor[:, :k]
        left[p] = False
        factor[p, k] = np.sqrt(rest[p])
        factor[left, k] = (a[left, p] - factor[left, :k] @ factor[p, :k]) / factor[p, k]
        rest -= factor[:, k] ** 2
    return factor


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit left singular vectors of a factor and its squared singular values, by falling value.

    Columns are rotated in pairs until all are orthogonal; a round rotates disjoint pairs together, and the rounds of a
    sweep bring each pair together once.
    """
    w = factor.copy()
    r = w.shape[1]
    seats = np.arange(r + r % 2)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = w[:, p], w[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(c) > np.finfo(float).eps * np.sqrt(a * b)
            if turn.any():
                turned = True
                p, q, x, y, a, b, c = p[turn], q[turn], x[:, turn], y[:, turn], a[turn], b[turn], c[turn]
                zeta = (b - a) / (2 * c)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                cos = 1 / np.hypot(1, t)
                sin = cos * t
                w[:, p], w[:, q] = cos * x - sin * y, sin * x + cos * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    values = (w * w).sum(0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 0]
    return w[:, order] / np.sqrt(values[order]), values[order]


def _sums(rows: DataFrame, vec_col: str) -> tuple[int, int, np.ndarray]:
    """Commonest length, count and exact sums of the vectors that have it."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for size in np.unique(usable(batch.column(0))[1]).tolist():
                _, x = integers(batch.column(0), size)
                found = held.setdefault(size, [0, np.zeros(size, np.int64)])
                found[0] += len(x)
                found[1] += x.sum(0)
        for size, (n, total) in held.items():
            yield pa.RecordBatch.from_pydict({"size": [size], "n": [n], "total": [total.tolist()]})

    parts = saved(rows.select(vec_col).mapInArrow(run, "size bigint, n bigint, total array<bigint>"), "sums")
    first = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if first is None:
        return 0, 0, np.empty(0, np.int64)
    own = parts.where(F.col("size") == first["size"]).select(F.posexplode("total").alias("i", "x"))
    found = {r["i"]: r["x"] for r in own.groupBy("i").agg(F.sum("x").alias("x")).collect()}
    return first["size"], first["n"], np.array([found[i] for i in range(first["size"])], np.int64)


def _covariance(rows: DataFrame, vec_col: str, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance of the integer vectors with divisor n, each centred before it is multiplied."""
    size = len(sums)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            _, x = integers(batch.column(0), size)
            z = scaled_deviation(x, n, sums) / n
            total += z.T @ z
        at, scatter = pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([at, scatter], names=["i", "scatter"])

    parts = rows.select(vec_col).mapInArrow(run, "i bigint, scatter array<double>")
    found = parts.select("i", F.posexplode("scatter").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    v = np.zeros((size, size))
    v[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return (v + v.T) / (2 * n)


def fit(rows: DataFrame, k: int = 8, vec_col: str = "embedding") -> Whitening:
    """The first ``k`` components of all usable vectors."""
    size, n, sums = _sums(rows, vec_col)
    if not n:
        return Whitening(0, sums, np.empty((0, 0)), np.empty(0), 0.0)
    v = _covariance(rows, vec_col, n, sums)
    components, values = jacobi(pivoted_cholesky(v))
    return Whitening(n, sums, components[:, :k], values[:k], float(v.trace()))


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector: id, ``deviation`` (squared, of n times the vector) and ``whitened``, an array."""
    schema = T.StructType(
        [
            field_of(rows, id_col),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ]
    )
    k = len(model.eigenvalues)
    onto = model.components / np.sqrt(model.eigenvalues) if k else np.empty((len(model.sums), 0))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not model.n:
                return
            at, x = integers(batch.column(1), len(model.sums))
            far = scaled_deviation(x, model.n, model.sums)
            if far.size and (far.astype(float) ** 2).sum(1).max() >= 2.0**63:
                raise OverflowError("a deviation is beyond a long")
            told = (far / model.n) @ onto
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array((far * far).sum(1)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(told.ravel())),
                ],
                names=schema.names,
            )

    return rows.select(id_col, F.col(vec_col).alias("__vector")).mapInArrow(run, schema)


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance (divisor n, centred) of whitened vectors less the identity."""
    if not k:
        return 0.0
    entry = [F.col("whitened")[i] for i in range(k)]
    found = whitened.agg(*[F.covar_pop(entry[i], entry[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def components(rows: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    model = fit(rows, k, vec_col)
    found = len(model.eigenvalues)
    table = saved(whiten(rows, model, id_col, vec_col), "whitened")
    error = identity_error(table, found)
    share = F.array(*[F.lit(float(e) / model.trace) for e in model.eigenvalues]) if found else F.array().cast("array<double>")
    return table.select(id_col, "deviation", F.posexplode("whitened").alias("component", "whitened")).select(
        id_col,
        (F.col("component") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
