"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Scans of the table give, in turn, the number of vectors with each dimension's sum (exact), the scatter of the centred vectors
(each task adds up its own, tasks' sums meet row by row of the scatter) and the covariance of the whitened vectors (what the
identity error is read from); the last scan writes the rows. Only the scatter, dimensions by dimensions, reaches the driver,
which factors it: pivots by falling diagonal until the rest is rounding, ``scatter = P L L' P'``; rotations of pairs of
L's columns, disjoint pairs at a time, until all are orthogonal. Their squared lengths over n are the eigenvalues, the
columns of length one are the components.

The shift by 100,000 that makes entries positive cancels wherever a mean is taken off, so it is never added.

Defined results: vectors that are null or hold null or non-finite entries take no part (they have no row); shorter
vectors count as filled up with zeros; repeated rows and null ids are vectors like others; with fewer dimensions than
components there are as many components as dimensions; a component without variance (beyond the scatter's rank) has null
as ``whitened`` and explains 0, or null if nothing varies; ``identity_error`` is over the components with variance, null if there are none; a deviation
beyond a long is null (``distance``, the squared distance from the mean, still holds); an empty table, or one of empty vectors, gives
an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.llm import textops as ops
from factloom.llm import vectors

COMPONENTS = 8
#: Sweeps over all pairs of columns; a sweep squares what is left, so some ten do.
SWEEPS = 60
_LONG = 1 << 63


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): L of full column rank, L @ L.T is a[order][:, order] up to rounding."""
    n = len(a)
    order, left, low = np.arange(n), a.diagonal().copy(), np.zeros((n, n))
    least = n * np.finfo(float).eps * left.max(initial=0.0)
    for k in range(n):
        at = k + int(left[k:].argmax())
        if left[at] <= least:
            return low[:, :k], order
        for x in (order, left, low):
            x[[k, at]] = x[[at, k]]
        low[k, k] = np.sqrt(left[k])
        low[k + 1 :, k] = (a[order[k + 1 :], order[k]] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
        left[k + 1 :] -= low[k + 1 :, k] ** 2
    return low, order


def orthogonal_columns(low: np.ndarray) -> np.ndarray:
    """The columns of ``low``, as rows, turned by plane rotations of pairs until they are orthogonal."""
    own = low.T.copy()
    n = len(own)
    near = max(low.shape) * np.finfo(float).eps
    ring = list(range(n + n % 2))  # a round-robin: everyone meets everyone once in a sweep, an odd one out rests
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(p, q) for p, q in zip(ring[:half], ring[:half - 1:-1], strict=True) if max(p, q) < n]
            p, q = (np.array(side, int) for side in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
            x, y = own[p], own[q]
            xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            cosine = np.abs(xy) / np.sqrt(np.maximum(xx * yy, np.finfo(float).tiny))
            worst = max(worst, cosine.max(initial=0.0))
            slope = (yy - xx) / np.where(xy == 0, 1.0, 2 * xy)
            tangent = np.where(xy == 0, 0.0, np.where(slope < 0, -1.0, 1.0) / (np.abs(slope) + np.hypot(1.0, slope)))
            c = 1 / np.hypot(1.0, tangent)
            s = c * tangent
            own[p], own[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst <= near:
            break
    return own


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as rows) of a positive semi-definite matrix, by falling eigenvalue, as many as its rank."""
    low, order = pivoted_cholesky(scatter)
    turned = orthogonal_columns(low)
    size = (turned**2).sum(axis=1)
    rank = np.argsort(-size, kind="stable")
    components = np.zeros_like(turned)
    components[:, order] = turned / np.sqrt(size)[:, None]
    return size[rank], components[rank]


class _Centre:
    """Vectors minus their mean: n and the sums are exact, so n * x - S is."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.exact = n, np.array(sums, object)
        # int64 where no number can pass it.
        self.fits = n * most + max(map(abs, sums), default=0) < _LONG
        self.sums = self.exact.astype(np.int64) if self.fits else self.exact

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S."""
        return (x if self.fits else x.astype(object)) * self.n - self.sums

    def deviation(self, scaled: np.ndarray) -> list[int | None]:
        most = max(int(scaled.max(initial=0)), -int(scaled.min(initial=0)))
        if not self.fits or most**2 * scaled.shape[1] >= _LONG:
            scaled = scaled.astype(object)
        return [int(d) if d < _LONG else None for d in (scaled * scaled).sum(axis=1).tolist()]


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def _sums(rows: DataFrame) -> tuple[int, list[int], int]:
    """Number of vectors, each dimension's sum, the largest entry's size. Tasks send a row for each dimension."""
    kinds = to_arrow_schema(_schema("dim int, total decimal(38,0), most bigint, n bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, total = 0, 0, np.zeros(0, object)
        for part, x in vectors.chunks(batches):
            n += part.num_rows
            most = max(most, int(np.abs(x).max(initial=0)))
            total = np.concatenate([total, np.zeros(max(0, x.shape[1] - len(total)), object)])
            total[: x.shape[1]] += x.sum(axis=0).astype(object)
        # The row of dimension -1 counts.
        columns = ([-1, *range(len(total))], [Decimal(0), *map(Decimal, total)], [most] * (len(total) + 1), [n] + [0] * len(total))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    found = {r["dim"]: r for r in rows.select("x").mapInArrow(run, "dim int, total decimal(38,0), most bigint, n bigint").groupBy("dim").agg(F.sum("total").alias("total"), F.max("most").alias("most"), F.sum("n").alias("n")).collect()}
    if -1 not in found:
        return 0, [], 0
    return found[-1]["n"], [int(found[d]["total"]) for d in range(len(found) - 1)], found[-1]["most"]


def _products(rows: DataFrame, dims: int, width: int, make: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> np.ndarray:
    """The sum over all vectors of y' y, y what ``make()`` makes of them (``width`` numbers and a 1, so that sums come along).

    Each task adds up its own; tasks' sums meet by row of the matrix.
    """
    schema = "i int, own array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, work = np.zeros((width + 1, width + 1)), make()
        for part, x in vectors.chunks(batches, dims):
            y = np.concatenate([work(x), np.ones((part.num_rows, 1))], axis=1)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "own"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width + 1)
        for batch in table.to_batches():
            total += batch.column("own").flatten().to_numpy().reshape(-1, width + 1).sum(axis=0)
        return pa.table({"i": table["i"][:1], "own": pa.array([total], pa.list_(pa.float64()))})

    out = np.zeros((width + 1, width + 1))
    for r in rows.select("x").mapInArrow(run, schema).groupBy("i").applyInArrow(add, schema).collect():
        out[r["i"]] = r["own"]
    return out


def whiten(table: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error, distance): a row for each vector and component."""
    spark = table.sparkSession
    ops.bounded(spark)
    rows = vectors.whole(table, id_col, vec_col)
    schema = T.StructType([T.StructField(id_col, table.schema[id_col].dataType), *_schema("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, distance double").fields])
    n, sums, most = _sums(rows)
    dims = len(sums)
    if not dims:
        return spark.createDataFrame([], schema)
    centre = spark.sparkContext.broadcast(_Centre(n, sums, most))

    def centred(x: np.ndarray) -> np.ndarray:
        return centre.value.scaled(x).astype(np.float64) / n

    scatter = _products(rows, dims, dims, lambda: centred)[:dims, :dims]
    size, axes = principal((scatter + scatter.T) / 2)
    found = min(components, len(size))
    trace = scatter.trace()
    turn = spark.sparkContext.broadcast((axes[:found] / np.sqrt(size[:found] / n)[:, None]).T.copy())
    error = None
    if found:
        second = _products(rows, dims, found, lambda: lambda x: centred(x) @ turn.value) / n
        mean = second[found, :found]
        error = float(np.abs(second[:found, :found] - np.outer(mean, mean) - np.eye(found)).max())
    shown = min(components, dims)
    explained = [float(e / trace) if trace > 0 else None for e in [*size[:shown], *[0.0] * (shown - found)]]
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = centre.value
        for part, x in vectors.chunks(batches, dims):
            rows, scaled = part.num_rows, own.scaled(x)
            y = scaled.astype(np.float64) / n
            white = np.full((rows, shown), np.nan)
            white[:, :found] = y @ turn.value
            again = np.repeat(np.arange(rows), shown)
            columns = [
                part.column("id").take(pa.array(again)),
                np.tile(np.arange(1, shown + 1, dtype=np.int32), rows),
                np.full(rows * shown, n),
                pa.array(own.deviation(scaled), pa.int64()).take(pa.array(again)),
                pa.array(white.ravel(), from_pandas=True),
                pa.array(explained * rows, pa.float64()),
                pa.array([error] * (rows * shown), pa.float64()),
                (y * y).sum(axis=1)[again],
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=kinds)

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over embeddings."""
    return whiten(ops.read(spark, sf_dir, "embeddings"))
