"""What must hold at any size: no step of a query makes, ships or works out more than its job needs."""

import math

import pytest

from factloom.functions import quantity, text, validity
from factloom.operators import audit, graph, retrieval
from factloom.plans.facts import number_value
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_missing_pairs_are_not_shuffled(spark):
    left = spark.createDataFrame([(i, i % 3) for i in range(200)] + [(None, 1), (7, None)], "a bigint, g int")
    right = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(4, 1), (None, 2), (5, None)], "b bigint, g int")
    edges = spark.createDataFrame([(i % 97, i % 31) for i in range(900)] + [(5, None), (None, 4)], "a bigint, b bigint")
    got = graph.missing_pairs(left, right, ["g"], ("a", "b"), edges)
    want = left.join(right, "g").join(edges, ["a", "b"], "left_anti").select("a", "b")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "LeftAnti" not in plan_of(got)
    assert graph.missing_pairs(left.where("false"), right, ["g"], ("a", "b"), edges).count() == 0


def test_cosine_top_k_of_odd_vectors_without_a_join_of_pairs(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(90)]
    rows += [(100, None), (101, [0.0] * 4), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, 2.0]), (104, []), (120, [0.0] * 4), (140, [1.0, 2.0]), (160, None), (7, [1.0, 2.0, 3.0, 4.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def score(a, b):
        if not a or not b or len(a) != len(b) or None in (*a, *b) or not any(a) or not any(b):
            return 0.0
        return max(0.0, 1 - (1 - sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)) / 2)

    want = {q: sorted((-round(score(a, b), 9), v) for v, b in rows)[:5] for q, a in rows if q % 20 == 0}
    for most in (10_000, 3):
        found = retrieval.vector_top_k(queries, vectors, 5, most)
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append((-round(r.score, 9), r.vec_id))
        assert {q: [s for s, _ in x] for q, x in got.items()} == {q: [s for s, _ in x] for q, x in want.items()}
        assert got[120] == want[120] == [(-0.0, i) for i in range(5)]
        assert not any(x in plan_of(found) for x in ("NestedLoop", "Cartesian"))


@pytest.mark.parametrize(
    "made, parts, most",
    [
        (lambda c: quantity.gases(c), "regexp_replace", 2),
        (lambda c: quantity.normalized(c, F.lit("HAS_RADIUS")), "(?<=", 4),
        (lambda c: quantity.normalized(c, F.col("r")), "(?U)", 8),
        (lambda c: validity.stated_number(c), "ltrim", 1),
        (lambda c: validity.strict_fault(F.col("r"), c), "(?U)", 9),
        (lambda c: text.number_text(c.cast("double")), "format_string", 1),
    ],
)
def test_what_a_value_needs_is_worked_out_once_a_row(spark, made, parts, most):
    df = spark.range(3).select(F.concat(F.lit("1"), F.col("id").cast("string")).alias("o"), F.lit("HAS_MASS").alias("r"))
    assert 1 <= df.select(made(F.col("o")).alias("v"))._jdf.queryExecution().analyzed().toString().count(parts) <= most


def test_a_date_is_a_date_in_any_number_of_digits(spark):
    cases = {"1990": True, "199": True, "19": False, "1990-5": True, "1990-005-01": True, "1990-13": False, "1990年5月": False, "-300": False, "12345": False, "1990/5/6": True}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.d for r in df.select("c", validity.stated_date(F.col("c")).alias("d")).collect()} == cases


def test_records_of_a_source_are_not_sorted_to_be_grouped(spark):
    rows = [("s", "r", o, src, n, i) for i, (o, src, n) in enumerate([("1", "a", 1.5), ("1", "a", 1.2), ("2", "a", 2.0), ("1", "b", 1.9), ("3", "b", 3.0), ("4", "c", None)])]
    df = spark.createDataFrame(rows, "subject string, relation string, object string, source_name string, number double, ordinal bigint")
    columns = ["source_name", "first", "low", "high", "first_ordinal", "objects", "shares"]
    got, want = (sorted(map(str, audit.by_source(df, number_value(), *more).select(*columns).collect())) for more in (("number",), ()))
    assert got == want


def test_missing_pairs_take_a_small_part_of_a_byte_each(spark, tmp_path):
    left = spark.range(3000).select(F.col("id").alias("a"), F.lit(1).alias("g"))
    right = spark.range(1000).select((F.col("id") * 7919).alias("b"), F.lit(1).alias("g"))
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") % 1000 * 7919).alias("b"))
    graph.missing_pairs(left, right, ["g"], ("a", "b"), edges).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000 * 1000 - 3000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 3000 * 1000 / 2


def test_missing_pairs_of_equal_rows_and_dense_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_ROWS", 4)
    left = spark.createDataFrame([(i % 5, 0) for i in range(60)] + [(None, 0)] * 9 + [(i, 1) for i in range(20)] + [(3, None)], "a int, g int")
    right = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(4, 0), (None, 0), (None, 0)], "b bigint, g int")
    edges = spark.createDataFrame([(a, b) for a in range(4) for b in range(10)] * 2, "a bigint, b bigint")
    got = graph.missing_pairs(left, right, ["g"], ("a", "b"), edges)
    want = left.join(right, "g").join(edges, ["a", "b"], "left_anti").select("a", "b")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    monkeypatch.setattr(graph, "BLOCK_PAIRS", 1)
    assert sorted(map(str, graph.missing_pairs(left, right, ["g"], ("a", "b"), edges).collect())) == sorted(map(str, want.collect()))
