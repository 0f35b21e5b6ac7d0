import math

import numpy as np
import pytest
from factloom.operators import retrieval, vector_index
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    x[:400] = x[0]  # a hot vector
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)] + [(-1, None, 1), (-2, [0.0] * 16, 1), (-3, [None] * 16, 1), (-4, [math.nan] * 16, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int").repartition(3)


def test_recall_and_exact_scores(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "GROUP_ROWS", 100)
    monkeypatch.setattr(vector_index, "GROUP_QUERIES", 10)
    queries = vectors.where("vec_id % 20 = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    centres = vector_index.fit_cells(vectors)
    assert len(centres) == 38 and np.allclose(np.linalg.norm(centres, axis=1), 1)
    indexed = vector_index.index(vectors, centres)
    assert indexed.count() == 1500
    probes = vector_index.probes_for(vectors, centres, 5)
    assert 1 <= probes < 38
    found = vector_index.search(indexed, vectors, queries, centres, 5, probes=probes).toPandas()
    exact = retrieval.vector_top_k(queries, vectors.where("vec_id >= 0"), 5).toPandas()
    assert len(found) == len(exact) == 5 * queries.count()
    both = found.merge(exact, on=["query_id", "rank"])
    # Equal vectors may stand for each other: a neighbour counts as found if its score is.
    assert (np.abs(both["score_x"] - both["score_y"]) < 1e-6).mean() >= 0.9
    same = found.merge(exact, on=["query_id", "vec_id"])
    assert np.allclose(same["score_x"], same["score_y"])


def test_all_cells_are_exact(spark, vectors):
    queries = vectors.where("vec_id in (500, 777, 1200)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    centres = vector_index.fit_cells(vectors, cells=9, rounds=2, sample_rows=300)
    found = vector_index.search(vector_index.index(vectors, centres), vectors, queries, centres, 5, probes=9)
    exact = retrieval.vector_top_k(queries, vectors.where("vec_id >= 0"), 5)
    pick = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in df.collect())
    assert pick(found) == pick(exact)


def test_no_vectors(spark, vectors):
    none = vectors.where("vec_id < 0")
    centres = vector_index.fit_cells(none)
    queries = vectors.limit(2).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert len(centres) == 0 and vector_index.probes_for(none, centres, 5) == 1
    assert vector_index.search(vector_index.index(none, centres), none, queries, centres, 5, probes=1).collect() == []
