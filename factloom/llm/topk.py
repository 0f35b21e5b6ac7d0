"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A dimension is a term. The candidates of a slice become postings, for each term the rows where its entry isn't zero and
those entries; a query is sparse, its terms and weights. Term by term the queries' weights times the postings are
scattered into an array of scores, one for each query and candidate. Partition selection then keeps a slice's best,
which merge into the task's best of each query; tasks send ``k + 1`` rows for each query at most, and a window ranks them.

The queries go in blocks of about ``BLOCK_BYTES``, each a broadcast of that size, and every block meets all candidates in one
scan that shuffles no vector. With several blocks each one's result is written before the next starts, so that what
lies on disk doesn't add up.

Scores are exact integers (beyond a long they wrap). A query's own row is dropped once: the rows are compared by id and
score, and rows alike in both are interchangeable.

Defined results: vectors that are null or hold null or non-finite entries take no part, nor do rows without an id (no
result could name them); shorter vectors count as filled up with zeros; an empty vector scores 0 with all; ties go to the
smaller id; repeated rows are candidates one by one, and a query each; fewer candidates than k give them all;
an empty table, or one without queries, gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import textops as ops
from factloom.llm import vectors

K, EVERY = 10, 100
#: Bytes of a block's queries, as longs.
BLOCK_BYTES = 8 << 20
#: Queries whose scores with a slice of candidates are held at a time.
QUERIES = 128
#: Copies of a query that one row is unfolded into at a time.
_COPIES = 4096
_NONE = -(2**63) + 1
_FOUND = "q int, query_id bigint, copies bigint, own bigint, vec_id bigint, score bigint"


class _Best:
    """The best ``keep`` candidates so far of each query, by falling score and rising id."""

    def __init__(self, queries: int, keep: int):
        self.score = np.full((queries, keep), _NONE, np.int64)
        self.id = np.full((queries, keep), np.iinfo(np.int64).max, np.int64)

    def merge(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of the queries from ``first`` on (rows) with the candidates ``ids``."""
        n, keep = len(scores), self.score.shape[1]
        own = slice(first, first + n)
        # Nothing below a query's keep-th best, of the slice or of what it has, can stay.
        at_least = self.score[own, -1]
        if len(ids) > keep:
            at_least = np.maximum(at_least, np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep])
        kind = np.iinfo(scores.dtype)
        q, at = np.nonzero(scores >= np.clip(at_least, kind.min, kind.max).astype(scores.dtype)[:, None])
        if not len(q):
            return
        queries = np.concatenate([np.repeat(np.arange(n), keep), q])
        score = np.concatenate([self.score[own].ravel(), scores[q, at].astype(np.int64)])
        names = np.concatenate([self.id[own].ravel(), ids[at]])
        order = np.lexsort((names, ~score, queries))
        first_of = np.searchsorted(queries[order], np.arange(n))
        chosen = order[(first_of[:, None] + np.arange(keep)).ravel()]
        self.score[own] = score[chosen].reshape(n, keep)
        self.id[own] = names[chosen].reshape(n, keep)


def _terms(queries: np.ndarray, step: int) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each ``step`` queries their terms: (dimension, queries that have it, their weights)."""
    out = []
    for i in range(0, len(queries), step):
        part = queries[i : i + step]
        held = ((d, np.flatnonzero(part[:, d])) for d in range(part.shape[1]))
        out.append([(d, rows, part[rows, d]) for d, rows in held if len(rows)])
    return out


def _scatter(terms, postings, scores: np.ndarray) -> None:
    """Add each term's weights times its postings to the scores of its queries with its rows."""
    queries, rows = scores.shape
    room = np.empty_like(scores)
    for d, asking, weight in terms:
        at, entry = postings[d]
        if not len(at):
            continue
        if len(at) == rows and len(asking) == queries:
            scores += np.multiply(weight[:, None], entry, out=room)
        elif len(at) == rows:
            scores[asking] += weight[:, None] * entry
        else:
            scores[np.ix_(asking, at)] += weight[:, None] * entry


def _block(rows: DataFrame, asked: pa.Table, dims: int, keep: int) -> DataFrame:
    """For each query of a block and each task the task's best candidates."""
    ids = asked["id"].to_numpy()
    x = vectors.matrix(asked["x"], dims)
    sent = rows.sparkSession.sparkContext.broadcast((ids, x, asked["copies"].to_numpy(), (x * x).sum(axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, copies, own = sent.value
        best, terms = _Best(len(ids), keep), {}
        most = np.abs(x).max(axis=0, initial=0).astype(object)
        for part, entries in vectors.chunks(batches):
            d = min(dims, entries.shape[1])  # beyond, one side is zero
            entries = entries[:, :d]
            size = sum((most[:d] * np.abs(entries).max(axis=0, initial=0).astype(object)).tolist())
            kind = np.dtype(np.int32 if size < 1 << 31 else np.int64)
            if kind not in terms:
                terms[kind] = _terms(x.astype(kind), QUERIES)
            postings = {}
            for t in range(d):
                at = np.flatnonzero(entries[:, t])
                postings[t] = (at, entries[at, t].astype(kind))
            names = part.column("id").to_numpy()
            for i, own_terms in enumerate(terms[kind]):
                scores = np.zeros((min(QUERIES, len(ids) - i * QUERIES), len(names)), kind)
                _scatter([t for t in own_terms if t[0] < d], postings, scores)
                best.merge(i * QUERIES, scores, names)
        for i in range(0, len(ids), ops.BATCH_ROWS):
            q, at = np.nonzero(best.score[i : i + ops.BATCH_ROWS] > _NONE)
            q += i
            columns = (q.astype(np.int32), ids[q], copies[q], own[q], best.id[q, at], best.score[q, at])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "query_id", "copies", "own", "vec_id", "score"])

    return rows.mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int, own_is_there: bool) -> DataFrame:
    """A block's rows (query_id, rank, vec_id, score), each query without its own row."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("vec_id"))
    best = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + own_is_there)
    if own_is_there:
        mine = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("at"))
        best = best.withColumn("mine", F.coalesce(F.min(mine).over(Window.partitionBy("q")), F.lit(k + 1))).where(F.col("at") != F.col("mine"))
        best = best.withColumn("at", F.col("at") - (F.col("at") > F.col("mine")).cast("int"))
    # A query that stands in the table several times has its rows as often.
    folds = F.expr(f"sequence(0L, (copies - 1) div {_COPIES})")
    folded = best.select("query_id", F.col("at").cast("int").alias("rank"), "vec_id", "score", "copies", F.explode(folds).alias("_fold"))
    left = F.least(F.col("copies") - F.col("_fold") * _COPIES, F.lit(_COPIES))
    return folded.select("query_id", "rank", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), left.cast("int"))).alias("_copy")).drop("_copy")


def search(rows: DataFrame, asked: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, own_is_there: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of ``rows`` with the highest scores for each row of ``asked``.

    own_is_there: each row of ``asked`` is one of ``rows`` too, and doesn't count as its own candidate.
    """
    spark = rows.sparkSession
    ops.bounded(spark)
    rows = vectors.whole(rows, id_col, vec_col).where(F.col("id").isNotNull()).withColumn("id", F.col("id").cast("bigint"))
    asked = vectors.whole(asked, id_col, vec_col).where(F.col("id").isNotNull()).withColumn("id", F.col("id").cast("bigint"))
    asked = ops.cut(asked.groupBy("id", "x").agg(F.count(F.lit(1)).alias("copies")))
    n, dims = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    blocks = -(-n * 8 * max(dims, 1) // block_bytes)
    keep, out = k + own_is_there, None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id", "x"), F.lit(blocks)) == i).toArrow()
        if not part.num_rows:
            continue
        found = _ranked(_block(rows, part, dims, keep), k, own_is_there)
        found = found if blocks == 1 else ops.cut(found)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint") if out is None else out


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over embeddings."""
    rows = ops.read(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.pmod("vec_id", F.lit(EVERY)) == 0))


ORACLE_SQL = """
WITH whole AS (
    SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
    SELECT q.own, q.vec_id AS query_id, c.vec_id,
           CAST(coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.own <> c.own
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
