"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Vectors are put on an integer grid, so that means and scatter are exact sums whatever the order in
which tasks add them. The scatter of the distinct vectors (a matrix of dimension x dimension, all
that reaches the driver) is factored with pivoting; Jacobi rotations make the factor's columns
orthogonal. Their norms give the eigenvalues, the columns themselves the components.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headcount.llm.shared import cut, table

#: Steps of the grid in a unit, and the number added so that entries are positive.
STEPS, OFFSET = 64, 1_000_000
#: Components returned by the query.
COMPONENTS = 16
#: Largest whole number below which doubles add without rounding.
EXACT = 1 << 53
#: Tasks that add the sums of all others.
FAN = 32
#: Entries beyond it do not fit the grid.
LARGEST = 1 << 53


def _grid_row(values) -> bytes | None:
    if values is None or None in values:
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all():
        return None
    x = np.floor(x * STEPS)
    if (np.abs(x) >= LARGEST).any():
        raise ValueError(f"an entry of {values} is too large for the grid")
    return (x.astype(np.int64) + OFFSET).tobytes()


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            column = part.column(1)
            flat = column.flatten()
            if column.null_count or flat.null_count or not len(flat):
                made = [_grid_row(v) for v in column.to_pylist()]
            else:
                # No nulls: the whole batch at once.
                x = flat.to_numpy()
                ends = np.cumsum(column.value_lengths().to_numpy())
                good = np.isfinite(x)
                x = np.floor(np.where(good, x, 0) * STEPS)
                if (np.abs(x) >= LARGEST).any():
                    raise ValueError("an entry is too large for the grid")
                x = x.astype(np.int64) + OFFSET
                made = [
                    x[a:b].tobytes() if good[a:b].all() else None for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())
                ]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["id", "x"])


def grid(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``x`` (whole numbers floor(64 c) + 1,000,000 as 64-bit bytes) of every row that can be used.

    A vector that is null or holds null or non-finite entries is left out; an empty one stays, with no
    entries. An entry beyond 2^53 steps raises. Rows that repeat stay rows of their own, a null id too;
    other columns play no part.
    """
    if not isinstance(df.schema[vector].dataType, T.ArrayType):
        raise TypeError(f"{vector} is not an array column")
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_grid, f"id {kind}, x binary").where("x IS NOT NULL")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    data = column.to_pylist()
    if any(len(v) != 8 * size for v in data):
        raise ValueError("vectors differ in length")
    return np.frombuffer(b"".join(data), np.int64).reshape(len(data), size)


def _gram(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers as Python integers, exact: BLAS while no sum can round, object arithmetic beyond."""
    size = y.shape[1]
    out = np.zeros((size, size), object)
    # In Python's numbers, and from both ends: the absolute value of the least long is no long.
    most = max(int(y.max(initial=0)), -int(y.min(initial=0)), 1)
    block = min(EXACT // (most * most), 4096)
    if not block:
        wide = y.astype(object)
        return wide.T.dot(wide)
    for at in range(0, len(y), block):
        part = y[at : at + block].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _added(rows: DataFrame, partial) -> list:
    """Elementwise sum of partial(batches), a list of numbers for each task, or none.

    A task sends one row. The rows are added by FAN tasks, so that the driver adds FAN lists at most.
    """

    def first(batches):
        sums = partial(batches)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(sums)] if sums else [], pa.string())], names=["v"])

    def second(batches):
        total = None
        for batch in batches:
            for v in batch.column(0).to_pylist():
                own = np.array(json.loads(v), object)
                total = own if total is None else total + own
        made = [] if total is None else [json.dumps(total.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["v"])

    lists = rows.mapInArrow(first, "v string").repartition(FAN).mapInArrow(second, "v string").collect()
    return sum((np.array(json.loads(r["v"]), object) for r in lists[1:]), np.array(json.loads(lists[0]["v"]), object)).tolist() if lists else []


def _sums(rows: DataFrame, size: int, centre: list[int] | None) -> tuple[int, list[int], list[list[int]] | None]:
    """Count, sums of (x - centre) and, with a centre, their products, exact over all tasks."""
    upper = np.triu_indices(size)

    def partial(batches):
        n, total, square = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for at in range(0, len(x), 4096):
                y = x[at : at + 4096]
                y = y - np.array(centre, np.int64) if centre else y
                n += len(y)
                total += y.astype(object).sum(axis=0)
                if centre:
                    square += _gram(y)
        return [int(v) for v in (n, *total, *(square[upper] if centre else ()))] if n else None

    n, *found = _added(rows.select("x"), partial) or [0] * (1 + size + len(upper[0]))
    square = None
    if centre:
        half = np.zeros((size, size), object)
        half[upper] = found[size:]
        square = (half + np.triu(half, 1).T).tolist()
    return n, found[:size], square


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L', one column for each positive pivot; the largest pivot left goes first.

    In the order of the pivots L is lower triangular; its rows are those of v. A pivot that is lost in
    the rounding of its own diagonal entry is none, so a matrix of lower rank has a narrower factor.
    """
    size = len(v)
    left, diagonal = v.astype(float).copy(), np.diag(v).astype(float).copy()
    floor = size * np.finfo(float).eps * diagonal
    columns = []
    for _ in range(size):
        p = int(np.where(diagonal > floor, diagonal, 0).argmax())
        if diagonal[p] <= floor[p]:
            break
        column = left[:, p] / np.sqrt(diagonal[p])
        columns.append(column)
        left -= np.outer(column, column)
        left[p, :] = left[:, p] = 0
        diagonal = np.diag(left).copy()
    return np.array(columns).T.reshape(size, len(columns))


def jacobi(factor: np.ndarray, tolerance: float = 4e-16, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors (columns) of L L' by one-sided rotations of L's columns.

    A sweep meets all pairs of columns in rounds of disjoint pairs, as in a tournament, so each round
    is one array operation. It ends when all columns are orthogonal to working precision.
    """
    a = np.ascontiguousarray(factor.T)
    n = len(a)
    if n == 0:
        return np.zeros(0), a.T
    seats = list(range(n)) + [-1] * (n % 2)
    half = len(seats) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(len(seats) - 1, 1)):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[::-1][:half]) if p >= 0 and q >= 0 and p != q]
            if pairs:
                p, q = np.array(pairs).T
                x, y = a[p], a[q]
                xx, yy, xy = (np.einsum("ij,ij->i", g, h) for g, h in ((x, x), (y, y), (x, y)))
                scale = np.sqrt(xx * yy)
                off = np.divide(np.abs(xy), scale, out=np.zeros_like(xy), where=scale > 0)
                worst = max(worst, off.max())
                turn = off > tolerance
                slope = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
                t = np.where(turn, np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.hypot(1, slope)), 0.0)
                c = 1 / np.hypot(1, t)[:, None]
                s = c * t[:, None]
                a[p], a[q] = c * x - s * y, s * x + c * y
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst <= tolerance * 4:
            break
    norms = np.sqrt((a * a).sum(1))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, a[order].T / norms[order]


@dataclass(frozen=True)
class Whitening:
    """What a fit on ``n`` distinct vectors found. ``centre`` is near the means, ``shift`` the rest of them."""

    n: int
    sums: list[int]
    centre: list[int]
    shift: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float


def fit(rows: DataFrame) -> Whitening:
    """Whitening of the distinct ``x`` of grid rows, each counted once. No rows, or empty vectors, give no components.

    Sums of products are taken of x less a whole number next to the mean and corrected by the exact
    rest, in whole numbers; the covariance (divisor n) is rounded to doubles once.
    Vectors of different lengths raise. The driver holds the matrix of the dimensions and no more.
    """
    first = rows.select(F.length("x")).first()
    size = first[0] // 8 if first else 0
    n, sums, _ = _sums(rows, size, None)
    if not n or not size:
        return Whitening(n, sums, [], np.zeros(0), np.zeros(0), np.zeros((size, 0)), 0.0)
    centre = [round(Fraction(s, n)) for s in sums]
    _, rest, square = _sums(rows, size, centre)
    shift = np.array([float(Fraction(r, n)) for r in rest])
    covariance = np.array(
        [[float(Fraction(n * square[i][j] - rest[i] * rest[j], n * n)) for j in range(size)] for i in range(size)]
    )
    values, components = jacobi(pivoted_cholesky(covariance))
    return Whitening(n, sums, centre, shift, values, components, float(np.trace(covariance)))


def _whitened(x: np.ndarray, model: Whitening, most: int) -> np.ndarray:
    y = (x - np.array(model.centre, np.int64)).astype(np.float64) - model.shift
    return y @ (model.components[:, :most] / np.sqrt(model.values[:most]))


def identity_error(rows: DataFrame, model: Whitening, most: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows, less the identity; null without components."""
    k = min(most, len(model.values))
    if not k:
        return None
    size = len(model.centre)

    def partial(batches):
        n, total, square = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = _whitened(_matrix(batch.column(0), size), model, k)
            n, total, square = n + len(z), total + z.sum(0), square + z.T @ z
        return [n, *total.tolist(), *square.ravel().tolist()] if n else None

    n, *found = _added(rows.select("x"), partial)
    mean = np.array(found[:k], float) / n
    second = np.array(found[k:], float).reshape(k, k) / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact; raises where it does not fit 64 bits."""
    if not x.size:
        return [0] * len(x)
    s = np.array(sums, object)
    centre = np.array([round(Fraction(t, n)) for t in sums], np.int64)
    near = x - centre
    # n x - S = n (x - centre) + (n centre - S), where the second part is less than n.
    rest = (n * centre.astype(object) - s).astype(np.int64)
    most = n * (int(np.abs(near).max()) + 1)
    if most * most * x.shape[1] < 1 << 63:
        d = n * near + rest
        return (d * d).sum(1).tolist()
    d = x.astype(object) * n - s
    return [int(v) for v in (d * d).sum(1)]


def whiten(rows: DataFrame, model: Whitening, most: int) -> DataFrame:
    """``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` per grid row and component up to ``most``.

    Fewer components come out where the covariance has a lower rank.
    """
    k = min(most, len(model.values))
    size = len(model.centre)
    share = (model.values[:k] / model.trace).tolist() if k else []
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1), size)
                rows = np.repeat(np.arange(len(x)), k)
                deviation = pa.array(_deviation(x, model.n, model.sums), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(rows), model.n, np.int64)),
                        deviation.take(pa.array(rows)),
                        pa.array(_whitened(x, model, k).ravel()),
                        pa.array(np.tile(share, len(x))),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained"],
                )

    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double"
    return rows.select("id", "x").mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(table(spark, sf_dir, "embeddings"))
    distinct = cut(rows.select("x").distinct())
    model = fit(distinct)
    error = F.lit(identity_error(distinct, model, COMPONENTS)).cast("double").alias("identity_error")
    out = whiten(rows, model, COMPONENTS)
    return out.select(F.col("id").cast("long").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", error)
