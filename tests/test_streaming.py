from factloom.operators import retrieval
from factloom.streaming import incremental, snapshots

SCHEMA = "user_id long, event_id long, event_type string, value double, ts timestamp"


def rows(spark, *ids):
    return spark.createDataFrame([(i % 3, i, "click" if i % 2 else "view", float(i)) for i in ids], "user_id long, event_id long, event_type string, value double").selectExpr("*", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, event_id) as ts")


def test_only_new_files_are_loaded(spark, tmp_path):
    folder, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    args = (spark, folder, SCHEMA, target, check, ["user_id"], "event_id")
    rows(spark, 0, 1, 2, 3).coalesce(1).write.parquet(folder)
    assert incremental.load_new_files(*args) == 1 and incremental.load_new_files(*args) == 0
    latest = lambda: {r.user_id: r.event_id for r in snapshots.read(spark, target).collect()}
    assert latest() == {0: 3, 1: 1, 2: 2}
    rows(spark, 4, 0).coalesce(1).write.mode("append").parquet(folder)
    assert incremental.load_new_files(*args) == 1
    assert latest() == {0: 3, 1: 4, 2: 2}


def test_daily_counts_of_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows(spark, *range(60)).coalesce(1).write.parquet(folder)
    stream = incremental.daily_counts(spark.readStream.schema(SCHEMA).parquet(folder))
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("daily")) == key(incremental.daily_counts(rows(spark, *range(60))))


def test_large_dictionaries_find_the_same(spark):
    questions = spark.createDataFrame([(1, "What orbits MARS?"), (2, None), (3, ""), (4, "火星的质量")], "k int, q string")
    terms = spark.createDataFrame([(t,) for t in ("Mars", "mar", "orbit", "火星", "月球", "")], "term string")
    key = lambda df: sorted(map(str, df.collect()))
    small = retrieval.context(questions, terms, "q", ["k"])
    assert key(small) == key(retrieval.context(questions, terms, "q", ["k"], shard_signs=2))
    assert {r.k: r.entities for r in small.collect()} == {1: ["orbit", "Mars", "mar"], 2: [], 3: [], 4: ["火星"]}
