"""Approximate nearest vectors by an inverted-file index: cells of a distributed k-means, several probed for each query.

Centres come from Lloyd rounds over a bounded sample (``SAMPLE_ROWS``); every row is indexed. The index holds each vector's cell and
its direction in 8-bit steps. A search sends a query to the cells with the nearest centres, ranks what they hold by
the 8-bit directions, keeps ``candidate_k`` a query and ranks those again by their exact cosine. How many cells that are follows
from a wanted recall: ``probes_for`` finds the true neighbours of a bounded sample of rows and how far down their cells lie. Cells with many rows or
many queries are split, so that a task meets at most about ``GROUP_ROWS`` rows and ``GROUP_QUERIES`` queries.

Vectors that are null, zero or hold null or non-finite entries are in no cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import retrieval
from factloom.sources.tables import cut

SAMPLE_ROWS, MOST_CELLS, ROUNDS = 200_000, 4096, 6
GROUP_ROWS, GROUP_QUERIES = 20_000, 2_000
#: Rows whose true neighbours are looked up to choose the number of cells to probe.
TRIED_ROWS = 256
_STEPS = 127


def candidate_k(k: int) -> int:
    """How many candidates are ranked exactly: 15 for each asked for, 60 at least."""
    return max(15 * k, 60)


def _unit(v: Column) -> Column:
    """A vector of length one as doubles; null where it has none."""
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150)))
    return F.when(fine & (norm > 0), F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")), lambda p: p["x"] / p["n"]))


def _units(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), _unit(F.col(vec_col)).alias("unit")).where("unit is not null")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_cells(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, rounds: int = ROUNDS, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres (rows of length one) of about ``sqrt(rows)`` cells, ``MOST_CELLS`` at most.

    Each round's tasks send a sum and a number for each cell; the driver holds the centres alone.
    """
    rows = _units(vectors, id_col, vec_col)
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    cells = min(MOST_CELLS, n, cells or math.isqrt(n))
    place = F.xxhash64("id", "unit")
    sample = cut(rows.where(F.pmod(place, F.lit(1 << 30)) < F.lit(int(min(1.0, sample_rows / n) * (1 << 30)))))
    first = sample.groupBy("unit").agg(F.min(place).alias("place")).orderBy("place").limit(cells).toArrow()
    if not first.num_rows:
        return np.zeros((0, 0))
    centres = _matrix(first["unit"].combine_chunks()).copy()
    schema = "cell int, n bigint, total array<double>"
    for _ in range(rounds):
        sent = vectors.sparkSession.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            n, total = np.zeros(len(own), np.int64), np.zeros_like(own)
            for batch in batches:
                x = _matrix(batch.column("unit"))
                cell = (x @ own.T).argmax(axis=1)
                n += np.bincount(cell, minlength=len(own))
                np.add.at(total, cell, x)
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), pa.array(list(total[met]), pa.list_(pa.float64()))], names=["cell", "n", "total"])

        def add(table: pa.Table) -> pa.Table:
            total = _matrix(table["total"].combine_chunks()).sum(axis=0)
            return pa.table({"cell": table["cell"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "total": pa.array([total], pa.list_(pa.float64()))})

        for r in sample.select("unit").mapInArrow(assign, schema).groupBy("cell").applyInArrow(add, schema).collect():
            total = np.array(r["total"])
            if (size := np.linalg.norm(total)) > 0:
                centres[r["cell"]] = total / size
        sent.unpersist()
    return centres


def index(vectors: DataFrame, centres: np.ndarray, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cell, code): each vector's nearest centre and its direction in 8-bit steps."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("unit"))
            cell = (x @ sent.value.T).argmax(axis=1).astype(np.int32)
            codes = np.rint(x * _STEPS).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cell", "code"])

    rows = _units(vectors, id_col, vec_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cell int, code binary")


def probes_for(vectors: DataFrame, centres: np.ndarray, k: int, *, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", tried: int = TRIED_ROWS) -> int:
    """The least number of cells whose probing finds ``recall`` of the k nearest vectors of ``tried`` rows, chosen by hash."""
    if not len(centres):
        return 1
    rows = _units(vectors, id_col, vec_col)
    own = _matrix(rows.orderBy(F.xxhash64("unit", "id")).limit(tried).toArrow()["unit"].combine_chunks())
    sent = vectors.sparkSession.sparkContext.broadcast((own, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, centres = sent.value
        near, cells = np.full((len(own), k), -np.inf), np.zeros((len(own), k), np.int32)
        for batch in batches:
            x = _matrix(batch.column("unit"))
            near = np.concatenate([near, own @ x.T], axis=1)
            cells = np.concatenate([cells, np.broadcast_to((x @ centres.T).argmax(axis=1).astype(np.int32), (len(own), len(x)))], axis=1)
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            near, cells = np.take_along_axis(near, best, axis=1), np.take_along_axis(cells, best, axis=1)
        q, at = np.nonzero(near > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(near[q, at]), pa.array(cells[q, at])], names=["q", "near", "cell"])

    found = retrieval.top_per(rows.select("unit").mapInArrow(run, "q int, near double, cell int"), ["q"], [F.desc("near"), F.col("cell")], k).select("q", "cell").toPandas()
    order = np.argsort(np.argsort(-(own @ centres.T), axis=1, kind="stable"), axis=1)
    depth = np.sort(order[found["q"].to_numpy(), found["cell"].to_numpy()]) + 1
    return int(depth[max(0, math.ceil(recall * len(depth)) - 1)])


def search(indexed: DataFrame, vectors: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, *, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of the ``probes`` cells next to each query (query_id, query), ties to the smaller id."""
    spark = vectors.sparkSession
    asked = queries.select("query_id", _unit(F.col("query")).alias("unit")).where("unit is not null")
    kinds = {"q": asked.schema["query_id"].dataType.simpleString(), "v": vectors.schema[id_col].dataType.simpleString()}
    if not len(centres):
        return spark.createDataFrame([], f"query_id {kinds['q']}, {id_col} {kinds['v']}, score double, rank int")
    most = candidate_k(k)
    sent = spark.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(_matrix(batch.column("unit")) @ sent.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["query_id", "unit", "cells"])

    sends = asked.mapInArrow(nearest, f"query_id {kinds['q']}, unit array<double>, cells array<int>").select("query_id", "unit", F.explode("cells").alias("cell"))
    # One row a cell at most: into how many parts its rows and its queries go.
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).join(sends.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")), "cell")
    sizes = F.broadcast(cut(sizes.select("cell", parts("rows", GROUP_ROWS).alias("row_parts"), parts("asked", GROUP_QUERIES).alias("asked_parts"))))
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sends.join(sizes, "cell").select("query_id", "unit", "cell", dealt("asked_parts").alias("ask"), every("row_parts").alias("part"))
    right = indexed.join(sizes, "cell").select("id", "code", "cell", dealt("row_parts").alias("part"), every("asked_parts").alias("ask"))

    def meet(ask: pa.Table, rows: pa.Table) -> pa.Table:
        ids, found, names, scores = ask["query_id"].combine_chunks(), [], [], []
        if ask.num_rows and rows.num_rows:
            codes = np.stack([np.frombuffer(c, np.int8) for c in rows["code"].to_pylist()]).astype(np.float32)
            x = _matrix(ask["unit"].combine_chunks()).astype(np.float32)
            for i in range(0, len(x), 256):
                near = x[i : i + 256] @ codes.T / _STEPS
                best = np.argpartition(-near, most - 1, axis=1)[:, :most] if near.shape[1] > most else np.tile(np.arange(near.shape[1]), (len(near), 1))
                found.append(np.repeat(np.arange(i, i + len(near)), best.shape[1]))
                names.append(best.ravel())
                scores.append(np.take_along_axis(near, best, axis=1).ravel())
        at, of = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (found, names))
        return pa.table({"query_id": ids.take(at), "id": rows["id"].combine_chunks().take(of), "near": pa.array(np.concatenate(scores).astype(float) if scores else np.zeros(0))})

    key = ["cell", "part", "ask"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, f"query_id {kinds['q']}, id {kinds['v']}, near double")
    candidates = retrieval.top_per(met, ["query_id"], [F.desc("near"), F.col("id")], most)
    exact = _units(vectors, id_col, vec_col).withColumnRenamed("unit", "_own")
    dot = F.aggregate(F.zip_with("unit", "_own", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    again = candidates.select("query_id", "id").distinct().join(exact, "id").join(asked, "query_id").select("query_id", F.col("id").alias(id_col), F.greatest(F.lit(0.0), 1 - (1 - dot) / 2).alias("score"))
    return retrieval.top_per(again, ["query_id"], [F.desc("score"), F.col(id_col)], k)
