"""Whitening of embedding vectors on an exact covariance, refined to double precision.

Entries are put on an integer grid, so sums and centred products are exact whatever the
order that tasks finish in. The eigenvectors of the covariance are first taken in single
precision and then corrected by the matrix products of Ogita and Aishima in the widest
float that numpy has; clusters of eigenvalues are turned by problems of their own size.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The grid: steps per unit, and what is added so that entries are mostly positive.
STEPS, SHIFT = 1024, 100_000
#: Grid values beyond this are taken as this, so that they stay exact as doubles.
FARTHEST = 1 << 53
#: Components of a row.
TOP = 8
#: A component whose share of the trace is below this has no variance of its own.
FLAT = 1e-12

WIDE = np.longdouble
#: Eigenvalues nearer than this share of the largest entry are turned in a block of their own.
CLUSTER = 2.0**-27


def on_grid(entries: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 for each entry, as double integers."""
    return np.clip(np.floor(entries.astype(np.float64) * STEPS) + SHIFT, -FARTHEST, FARTHEST)


def vectors_of(batch: pa.RecordBatch, dims: int | None) -> tuple[pa.Array, np.ndarray]:
    """(ids, grid rows) of a batch (id, vector) without dropped rows; short vectors are filled with 0."""
    lists = batch.column(1)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # Nulls among entries are NaN here.
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = (broken[starts[1:]] == broken[starts[:-1]]) & pc.is_valid(lists).to_numpy(zero_copy_only=False)
    width = int(lengths[keep].max(initial=0)) if dims is None else dims
    if keep.all() and (lengths == width).all():
        rows = values.reshape(len(keep), width)
    else:
        rows = np.zeros((int(keep.sum()), width))
        for to, i in enumerate(np.flatnonzero(keep)):
            rows[to, : lengths[i]] = values[starts[i] : starts[i + 1]]
    return batch.column(0).filter(pa.array(keep)), on_grid(rows)


class Products:
    """The exact sum of rows' transpose times rows: in doubles while these hold every
    integer that may arise, then carried over into integers of any size."""

    def __init__(self, dims: int):
        self.total = np.zeros((dims, dims), object)
        self.part, self.bound = np.zeros((dims, dims)), 0.0

    def add(self, rows: np.ndarray) -> None:
        largest = float(np.abs(rows).max(initial=0))
        more = largest * largest * len(rows)
        if self.bound + more >= 2**53:
            self._carry()
        if more >= 2**53:
            whole = rows.astype(np.int64).astype(object)
            self.total = self.total + whole.T @ whole
        else:
            self.part += rows.T @ rows
            self.bound += more

    def _carry(self) -> None:
        self.total = self.total + self.part.astype(np.int64).astype(object)
        self.part[:], self.bound = 0, 0.0

    def upper(self) -> list[int]:
        self._carry()
        return list(self.total[np.triu_indices(len(self.part))])


def _sent(values: dict[int, int]) -> pa.RecordBatch:
    """(k, v) rows whose sums Spark takes."""
    return pa.record_batch([pa.array(list(values), pa.int64()), pa.array([Decimal(int(v)) for v in values.values()], pa.decimal128(38, 0))], ["k", "v"])


def _summed(rows: DataFrame, task) -> dict[int, int]:
    found = rows.mapInArrow(task, "k long, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v"))
    return {r["k"]: int(r["v"]) for r in found.toLocalIterator()}


def _column_sums(x: np.ndarray) -> list[int]:
    whole = x.astype(np.int64)
    if float(np.abs(x).max(initial=0)) * len(x) >= 2**62:
        whole = whole.astype(object)
    return [int(s) for s in whole.sum(0)] if len(x) else []


def fit_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, S) of (id, vector) rows: how many remain, and the sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for b in batches:
            for part in _parts(b):
                _, x = vectors_of(part, None)
                n += len(x)
                # Dimensions that a batch lacks hold the grid's zero in it; they are added up below.
                own = _column_sums(x)
                for j, s in enumerate(own):
                    if j == len(sums):
                        sums.append(SHIFT * (n - len(x)))
                    sums[j] += int(s)
                for j in range(x.shape[1], len(sums)):
                    sums[j] += SHIFT * len(x)
        yield _sent({-1: n} | {2 * j: s for j, s in enumerate(sums)} | {2 * j + 1: n for j in range(len(sums))})

    got = _summed(rows, add)
    n = got.get(-1, 0)
    dims = sum(1 for k in got if k >= 0) // 2
    # A task without a dimension adds nothing for its rows; each of them holds the grid's zero there.
    return n, [got[2 * j] + SHIFT * (n - got[2 * j + 1]) for j in range(dims)]


def _parts(batch: pa.RecordBatch, entries: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded size; one longer vector goes alone."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(lengths + 1, dtype=np.int64), 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + entries, "right")))
        yield batch.slice(first, last - first)
        first = last


def covariance(rows: DataFrame, n: int, sums: list[int]) -> list[list[int]]:
    """n * n * V exactly: products are taken about the integer nearest to each mean, then
    moved to the mean itself."""
    d = len(sums)
    middle = [round(s / n) for s in sums]
    centre = np.array(middle, np.float64)
    upper = np.triu_indices(d)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = Products(d)
        for b in batches:
            for part in _parts(b):
                products.add(vectors_of(part, d)[1] - centre)
        yield _sent(dict(enumerate(products.upper())))

    got = _summed(rows, multiply)
    left = [s - n * m for s, m in zip(sums, middle, strict=True)]
    out = [[0] * d for _ in range(d)]
    for k, (i, j) in enumerate(zip(*upper, strict=True)):
        out[i][j] = out[j][i] = n * got.get(k, 0) - left[i] * left[j]
    return out


def _clusters(values: np.ndarray, near: float) -> Iterator[slice]:
    """Runs of ascending values whose neighbours differ by ``near`` or less."""
    edges = np.flatnonzero(np.diff(values) > near) + 1
    for a, b in zip([0, *edges], [*edges, len(values)], strict=True):
        if b - a > 1:
            yield slice(int(a), int(b))


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima correction: (vectors, values, width of clusters, size of the correction)."""
    d = len(a)
    r = np.eye(d, dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    size = lambda m: float(np.sqrt((m * m).sum()))
    near = 2 * (size(off) + float(np.abs(values).max(initial=0)) * size(r))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > max(near, CLUSTER)
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, near, size(e)


def eigenvectors(a: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of a symmetric matrix, ascending.

    Starts from single precision. Corrections converge quadratically where eigenvalues are
    apart. Those that are not are turned by the eigenvectors of their own block, less its
    mean value and scaled up, which this function gives as well. Equal eigenvalues keep any
    basis of their space.
    """
    scale = float(np.ldexp(1.0, int(np.frexp(float(np.abs(a).max(initial=0)))[1])))  # a power of two, which rounds nothing
    a = a.astype(WIDE) / WIDE(scale)
    tiny = float(np.finfo(WIDE).eps) * max(len(a), 1)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    before = np.inf
    for _ in range(rounds):
        x, values, near, moved = _step(a, x)
        order = np.argsort(values, kind="stable")
        x, values = x[:, order], values[order]
        for part in _clusters(values, max(near, CLUSTER)):
            own = x[:, part]
            block = own.T @ ((a - values[part].mean() * np.eye(len(a), dtype=WIDE)) @ own)
            block = (block + block.T) / 2
            most = float(np.abs(block).max(initial=0))
            if most > tiny:
                x[:, part] = own @ eigenvectors(block / WIDE(most))[1]
        if moved < tiny or (moved < CLUSTER and moved > before / 2):
            break
        before = moved
    for _ in range(2):  # what rounding left of angles between neighbours
        x = x + x @ (np.eye(len(a), dtype=WIDE) - x.T @ x) / 2
    values = (x * (a @ x)).sum(0)
    order = np.argsort(values, kind="stable")
    return values[order] * WIDE(scale), x[:, order]


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP) -> DataFrame:
    """One row per remaining row of ``df`` and component: id, component, n, deviation,
    whitened, explained, identity_error.

    Rows whose vector is null or holds a null or an entry that is no finite number are
    dropped. Vectors shorter than the longest are filled with 0, the empty one too. There
    are as many components as dimensions, ``top`` at most; an eigenvector's largest entry
    is positive. Where a component has no variance (its share is below 1e-12: constant
    dimensions, one row, equal rows) ``whitened`` is null and ``identity_error`` leaves it
    out; it is 0 if none has any. ``explained`` is 0 where the trace is. ``deviation`` is
    null beyond 2^63 - 1. Grid values are held to 2^53 on either side. Rows that repeat,
    null ids and ids that repeat are rows of their own; an empty table gives no rows; other
    columns are not read. Three aggregations read the vectors before the result does; what
    comes to the driver is of the size of the covariance.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums = fit_sums(rows)
    d = len(sums)
    if not n or not d:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    exact = covariance(rows, n, sums)
    square = WIDE(n) * WIDE(n)
    v = np.array([[WIDE(x) for x in row] for row in exact], WIDE) / square
    values, vectors = eigenvectors(v)
    take = min(top, d)
    values, vectors = values[::-1][:take], vectors[:, ::-1][:, :take]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(take)])
    trace = v.trace()
    share = (values / trace if trace > 0 else values * 0).astype(np.float64)
    solid = share > FLAT
    project = np.where(solid, vectors / np.sqrt(np.where(solid, values, 1)), np.nan).astype(np.float64)
    middle = np.array([round(s / n) for s in sums], np.float64)
    rest = np.array([(s - n * round(s / n)) / n for s in sums], np.float64)
    error = _identity_error(rows, n, middle, rest, project[:, solid])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, (1 << 19) // take):
                ids, x = vectors_of(part, d)
                if len(x):
                    yield _result(ids, x, n, sums, middle, rest, project, solid, share, error)

    return rows.mapInArrow(score, schema).withColumnRenamed("id", id_col)


def _result(ids: pa.Array, x: np.ndarray, n: int, sums: list[int], middle: np.ndarray, rest: np.ndarray, project: np.ndarray, solid: np.ndarray, share: np.ndarray, error: float) -> pa.RecordBatch:
    near, take = x - middle, project.shape[1]
    got = (near - rest) @ np.where(solid, project, 0)
    repeat = lambda a: np.repeat(a, take)
    return pa.record_batch(
        [
            ids.take(pa.array(repeat(np.arange(len(x))))),
            pa.array(np.tile(np.arange(1, take + 1), len(x)), pa.int32()),
            pa.array(np.full(len(x) * take, n), pa.int64()),
            pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(repeat(np.arange(len(x))))),
            pa.array(got.ravel(), pa.float64(), mask=np.tile(~solid, len(x))),
            pa.array(np.tile(share, len(x)), pa.float64()),
            pa.array(np.full(len(x) * take, error), pa.float64()),
        ],
        ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    )


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None] | np.ndarray:
    """The sum over dimensions of (n * x - S) ** 2 of each row, in 64-bit integers where all fit."""
    most = max(n * int(np.abs(x).max(initial=0)) + abs(s) for s in sums)
    if most < 2**62:
        away = x.astype(np.int64) * n - np.array(sums, np.int64)
        if float(np.abs(away).max(initial=0)) ** 2 * len(sums) < 2**62:
            return (away * away).sum(1)
    away = x.astype(np.int64).astype(object) * n - np.array(sums, object)
    return [s if s < 2**63 else None for s in (away * away).sum(1)]


def _identity_error(rows: DataFrame, n: int, middle: np.ndarray, rest: np.ndarray, project: np.ndarray) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, from the rows."""
    d, k = project.shape
    if not k:
        return 0.0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for part in _parts(b):
                w = (vectors_of(part, d)[1] - middle - rest) @ project
                sums += w.sum(0)
                products += w.T @ w
        packed = np.concatenate([sums, products.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(packed)), pa.int64()), pa.array(packed, pa.float64())], ["k", "v"])

    got = rows.mapInArrow(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    packed = np.zeros(k + k * k)
    packed[got["k"].to_numpy(int)] = got["v"]
    mean = packed[:k] / n
    cov = packed[k:].reshape(k, k) / n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())
