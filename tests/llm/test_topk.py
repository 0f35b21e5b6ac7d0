import math

import duckdb
import numpy as np
import pytest
from factloom.llm import topk


def brute(rows, k=10):
    """All scores of each query row with every other row, sorted."""
    whole = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (i, q) in enumerate(whole):
        if i % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j) for m, (j, x) in enumerate(whole) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def vectors(seed, n, dims, sparse):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dims) * (rng.random(dims) < sparse)
        if rng.random() < 0.3:
            v = np.round(v)  # ties
        rows.append((int(rng.integers(0, n)) if rng.random() < 0.2 else i, [float(np.float32(c)) for c in v]))
    rows += [(900 + i, [0.5] * dims) for i in range(60)] + [rows[0]] * 5 + [(0, None), (None, [1.0] * dims), (100, [float("nan")] * dims), (200, [1.0]), (300, [])]
    return rows


@pytest.mark.parametrize(("seed", "dims", "sparse", "bytes_"), [(1, 8, 1.0, 1 << 23), (2, 16, 0.2, 400), (3, 1, 1.0, 1 << 23), (4, 5, 0.0, 100)])
def test_brute_force(spark, monkeypatch, seed, dims, sparse, bytes_):
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = vectors(seed, 250, dims, sparse)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = topk.search(df, df.where("vec_id % 100 = 0"), block_bytes=bytes_).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_scores_beyond_32_bits_and_few_candidates(spark):
    rows = [(0, [1e6, -3.5]), (1, [2e6, 1.0]), (2, [-2e6, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df, df.where("vec_id = 0")).collect())) == brute(rows)


def test_a_query_that_stands_often_has_its_rows_as_often(spark, monkeypatch):
    monkeypatch.setattr(topk, "_COPIES", 4)
    rows = [(0, [1.0, 2.0])] * 11 + [(i, [float(i), 1.0]) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df, df.where("vec_id = 0")).collect())) == brute(rows)


def test_sql_says_the_same(tmp_path):
    rows = vectors(5, 120, 6, 0.7)
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    db.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(db.execute(topk.ORACLE_SQL).fetchall()) == brute(rows)
