"""Whitening of embeddings by the leading components of their covariance.

Entries become whole numbers first, so that the statistics are exact: per-dimension sums and, of the
distinct vectors centred on the whole number next to their mean, products summed per task in doubles
that hold them exactly, then across tasks as decimals. What is left of the mean is taken off in whole
numbers, so every entry of the covariance is right to its last bit and does not depend on how rows are dealt.

The covariance, a square of the number of dimensions, is the only thing that the driver holds. It is
brought to tridiagonal form by Householder reflections; its leading eigenvalues are found by bisection
on Sturm counts, their vectors by inverse iteration in which the vectors of close eigenvalues are made
orthogonal to each other, and reflected back. The components, at most 16 of so many numbers, go to the tasks with the
function that projects the vectors.

Defined cases: vectors that are null or hold a null or non-finite entry are left out, as are those of
another length than the commonest (the longer on a tie) and empty ones. Entries of 2**45 or more in size
are cut off there, so that products stay exact. Directions without variance have no component; if there is none at all,
or no vector, there are no rows. Repeated rows are whitened each, but fitted once, as are equal vectors. Extra
columns, whatever their names, are not read. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.runtime import cut

# Fixed values of the contract: how entries become whole numbers, and the most components.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# Parameters: the most that entries may be once scaled; numbers a double holds exactly; eigenvalues
# closer than this share of the largest are a cluster; smaller shares of it are no variance.
LARGEST = 2**51
EXACT = 2**53
CLUSTER = 1e-3
NO_VARIANCE = 1e-13
LONG = 2**63
# Rows a task works on at a time.
CHUNK = 2048


# -- eigenvalues of a symmetric matrix -------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflections that bring a symmetric matrix to them."""
    a = matrix.astype(float).copy()
    size, mirrors = len(a), []
    for k in range(size - 2):
        column = a[k + 1 :, k]
        scale = np.abs(column).max()
        mirror = np.zeros(size - k - 1)
        if scale > 0 and np.abs(column[1:]).max() > 0:
            mirror = column / scale
            mirror[0] += np.copysign(np.linalg.norm(mirror), mirror[0])
            mirror /= np.linalg.norm(mirror)
            rest = a[k + 1 :, k + 1 :]
            push = rest @ mirror
            push -= (mirror @ push) * mirror
            rest -= 2 * (np.outer(mirror, push) + np.outer(push, mirror))
            column -= 2 * (mirror @ column) * mirror
        mirrors.append(mirror)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of `at`: negative pivots of the shifted matrix (Sturm)."""
    least = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0.0)))
    count, pivot = np.zeros(len(at), dtype=int), np.inf
    for d, e in zip(diagonal, np.concatenate([[0.0], off])):
        pivot = (d - at) - e * e / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, many: int) -> np.ndarray:
    """The `many` largest eigenvalues, falling, each cut down by bisection until no double lies between."""
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    margin = 4 * np.finfo(float).eps * max(abs(low), abs(high), np.finfo(float).tiny)
    lows, highs = np.full(many, low - margin), np.full(many, high + margin)
    wanted = len(diagonal) - 1 - np.arange(many)  # eigenvalues below the sought one
    while True:
        middle = lows + (highs - lows) / 2
        open_ = (middle > lows) & (middle < highs)
        if not open_.any():
            return middle
        above = below(diagonal, off, middle) <= wanted
        lows, highs = np.where(open_ & above, middle, lows), np.where(open_ & ~above, middle, highs)


def _solved(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """The solution of (T - value) x = right by elimination with row exchanges; pivots of 0 become tiny."""
    size = len(diagonal)
    tiny = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), 1e-100)
    a, b, c = diagonal - value, np.append(off, 0.0), np.zeros(size)  # pivot, next and next but one
    x = right.copy()
    for k in range(size - 1):
        under, beside, after = off[k], a[k + 1], b[k + 1]
        if abs(under) > abs(a[k]):
            share = a[k] / under
            a[k + 1], b[k + 1] = b[k] - share * beside, c[k] - share * after
            a[k], b[k], c[k] = under, beside, after
            x[k], x[k + 1] = x[k + 1], x[k] - share * x[k + 1]
        else:
            a[k] = a[k] if abs(a[k]) > tiny else tiny
            share = under / a[k]
            a[k + 1], b[k + 1] = beside - share * b[k], after - share * c[k]
            x[k + 1] -= share * x[k]
    a[-1] = a[-1] if abs(a[-1]) > tiny else tiny
    for k in range(size - 1, -1, -1):
        ahead = (b[k] * x[k + 1] if k + 1 < size else 0.0) + (c[k] * x[k + 2] if k + 2 < size else 0.0)
        x[k] = (x[k] - ahead) / a[k]
        if abs(x[k]) > 1e100:
            x /= abs(x[k])
    return x


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one a column, by inverse iteration."""
    size, draw = len(diagonal), np.random.default_rng(3)
    made = np.zeros((size, len(values)))
    apart = CLUSTER * max(abs(values[0]), np.finfo(float).tiny)
    first, shift = 0, 0.0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > apart:
            first = k
        # equal eigenvalues are told apart by a few units in the last place
        shift = min(value, shift - 4 * np.finfo(float).eps * abs(values[0])) if k > first else value
        x = draw.standard_normal(size)
        for _ in range(5):
            x = _solved(diagonal, off, shift, x / np.abs(x).max())
            for _ in range(2):
                for j in range(first, k):
                    x -= (made[:, j] @ x) * made[:, j]
            x /= np.linalg.norm(x)
        made[:, k] = x
    return made


def leading_components(matrix: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The `many` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading_values(diagonal, off, many)
    vectors = leading_vectors(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        part, mirror = vectors[k + 1 :], mirrors[k]
        part -= 2 * np.outer(mirror, mirror @ part)
    return values, vectors / np.linalg.norm(vectors, axis=0)


# -- statistics --------------------------------------------------------------------


@dataclass
class Whitening:
    """What whitens a vector. `components` has one a column; `sums` and `n` are of the distinct vectors."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float = 0.0


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors without null or non-finite entries, of the commonest length."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.forall("embedding", finite))
    lengths = whole.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", "length"))["length"]).first()[0]
    return whole.where(F.size("embedding") == (most or 0)).select("vec_id", "embedding")


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the whole numbers of each vector, eight bytes each."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                c = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)
                x = np.floor(np.clip(SCALE * c, -LARGEST, LARGEST)).astype("<i8") + SHIFT
                made = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), made], ["vec_id", "x"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(scaled, f"vec_id {kind}, x binary")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows at a time, with their vectors as the rows of a matrix."""
    for rows in batches:
        for start in range(0, rows.num_rows, CHUNK):
            part = rows.slice(start, CHUNK)
            whole = np.frombuffer(b"".join(part.column("x").to_pylist()), "<i8")
            yield part, whole.reshape(part.num_rows, -1)


def products(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers, exact: in doubles while they hold every sum, else in Python's numbers."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * len(y) < EXACT:
        part = y.astype(float)
        return (part.T @ part).astype(np.int64).astype(object)
    rows = max(1, EXACT // (largest * largest)) if largest * largest < EXACT else 0
    if rows:
        return sum(products(y[k : k + rows]) for k in range(0, len(y), rows))
    part = y.astype(object)
    return part.T @ part


def _summed(parts: DataFrame) -> dict[int, list]:
    """Rows (i, row) of all tasks added up by i: {i: row}, a square of the dimensions at most. A group has
    one row of a task."""
    whole = "decimal" in parts.schema["row"].dataType.simpleString()

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        if whole:
            total = [Decimal(sum(map(int, column))) for column in zip(*rows["row"])]
        else:
            total = np.sum(np.stack(list(rows["row"])), axis=0)
        return pd.DataFrame({"i": rows["i"].iloc[:1], "row": [total]})

    return {r.i: r.row for r in parts.groupBy("i").applyInPandas(added, parts.schema).collect()}


WHOLE_ROWS = "i int, row array<decimal(38,0)>"


def _parts(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(kind))], ["i", "row"])


def _whole_parts(rows: list[list[int]]) -> pa.RecordBatch:
    return _parts([[Decimal(int(v)) for v in row] for row in rows], pa.decimal128(38, 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = 0, 0
    for _, x in _chunks(batches):
        total, n = total + x.astype(object).sum(axis=0), n + len(x)
    if n:
        yield _whole_parts([[n, *total]])


def covariance(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """How many vectors, their sums, and their covariance, exact up to the last rounding."""
    found = _summed(fit.mapInArrow(_sums, WHOLE_ROWS))
    if not found:
        return 0, [], np.zeros((0, 0))
    n, *sums = map(int, found[0])
    size, centre = len(sums), np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((size, size), dtype=object), False
        for _, x in _chunks(batches):
            total, any_ = total + products(x - centre), True
        if any_:
            yield _whole_parts(total)

    found = _summed(fit.mapInArrow(of_task, WHOLE_ROWS))
    left = [s - n * int(c) for s, c in zip(sums, centre)]  # n times what is left of the mean
    made = [[(n * int(found[i][j]) - left[i] * left[j]) / (n * n) for j in range(size)] for i in range(size)]
    return n, sums, np.array(made)


def _whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    """(x - sums / n), exact before it is rounded, on the components and over the root of their variance."""
    base = np.array([s // model.n for s in model.sums], dtype=np.int64)
    rest = np.array([(s % model.n) / model.n for s in model.sums])
    return ((x - base) - rest) @ (model.components / np.sqrt(model.values))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the covariance of the whitened distinct vectors minus the identity."""
    many = len(model.values)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many, many + 1))
        for _, x in _chunks(batches):
            w = _whitened(model, x)
            total += np.column_stack([w.T @ w, w.sum(axis=0)])
        yield _parts(total.tolist(), pa.float64())

    found = _summed(fit.mapInArrow(of_task, "i int, row array<double>"))
    table = np.array([found[i] for i in range(many)]) / model.n
    mean = table[:, many]
    return float(np.abs(table[:, :many] - np.outer(mean, mean) - np.eye(many)).max())


def fit_whitening(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of `quantised`; None if they do not vary."""
    fit = cut(x.select("x").distinct())
    n, sums, matrix = covariance(fit)
    trace = float(np.trace(matrix))
    if not trace > 0:
        return None
    values, vectors = leading_components(matrix, min(components, len(matrix)))
    held = values > NO_VARIANCE * values[0]
    model = Whitening(n, sums, trace, values[held], vectors[:, held])
    model.identity_error = identity_error(fit, model)
    return model


def _deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """The sum of (n x - sums)**2 of each vector, exact, and null beyond a long."""
    base = np.array([s // model.n for s in model.sums], dtype=np.int64)
    rest = np.array([s % model.n for s in model.sums], dtype=np.int64)
    largest = int(np.abs(x - base).max(initial=0)) + 1
    if largest * model.n * largest * model.n * len(base) < LONG:
        apart = (x - base) * model.n - rest
        return (apart * apart).sum(axis=1).tolist()
    apart = (x - base).astype(object) * model.n - rest.astype(object)
    return [v if v < LONG else None for v in (apart * apart).sum(axis=1)]


def whiten(x: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): every vector of `quantised` on the components, largest first."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, whole in _chunks(batches):
            deviation = pa.array(_deviations(model, whole), pa.int64())
            whitened = pa.array(_whitened(model, whole).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), deviation, whitened], ["vec_id", "deviation", "whitened"])

    kind = x.schema["vec_id"].dataType.simpleString()
    return x.mapInArrow(of_task, f"vec_id {kind}, deviation bigint, whitened array<double>")


def judge(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for every vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    x = quantised(usable(embeddings))
    model = fit_whitening(x, components)
    if model is None:
        kind = x.schema["vec_id"].dataType.simpleString()
        schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    rows = whiten(x, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
