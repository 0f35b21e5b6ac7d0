import pytest
from factloom.streaming import snapshots
from pyspark.sql import functions as F


def test_publish_patch_fail_and_restore(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    one = snapshots.publish(spark, path, first, "first")
    two = snapshots.publish(spark, path, first.withColumn("v", F.upper("v")), "upper")
    assert (one.version, two.version, one.rows) == (1, 2, 3) and one.digest != two.digest
    with monkeypatch.context() as m:  # killed between the data and its entry
        m.setattr(snapshots, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            snapshots.publish(spark, path, first.limit(1), "half")
    assert snapshots.current(spark, path).version == 2
    three = snapshots.restore(spark, path, 1)
    assert three.digest == one.digest and sorted(map(tuple, snapshots.read(spark, path).collect())) == [(1, "a"), (2, "b"), (2, "b")]
    assert sorted(r.v for r in snapshots.read(spark, path, 2).collect()) == ["A", "B", "B"]
    with pytest.raises(ValueError):
        snapshots._commit(spark, path, snapshots.Snapshot(3))
    assert snapshots.vacuum(spark, path, keep=1) == 2 and snapshots.read(spark, path).count() == 3 and len(snapshots.log(spark, path)) == 1
    with pytest.raises(ValueError):
        snapshots.read(spark, path, 1)


def test_buckets_by_definition(spark):
    for n in range(1, 20):
        rows = spark.range(500).select(F.xxhash64("id").alias("h"), snapshots.bucket(["id"], n).alias("b")).collect()
        level = 1 << (n.bit_length() - 1)
        assert all(r.b == (r.h % (2 * level) if r.h % (2 * level) < n else r.h % level) for r in rows)
        wider = {r.h: r.b for r in spark.range(500).select(F.xxhash64("id").alias("h"), snapshots.bucket(["id"], n + 3).alias("b")).collect()}
        assert all(wider[r.h] == r.b or (wider[r.h] >= n and snapshots.divided_from(wider[r.h], n) == r.b) for r in rows)


def test_buckets_divide_as_rows_grow(spark, tmp_path):
    path, want = str(tmp_path / "k"), {}
    for batch in range(5):
        rows = [((batch * 37 + i) % 120, batch * 100 + i, f"v{batch}") for i in range(50 if batch else 20)]
        for k, o, v in rows:
            want[k] = (o, v)
        df = spark.createDataFrame(rows, "k int, o int, v string")
        made = snapshots.upsert(spark, path, df, ["k"], "o", batch=f"b{batch}", bucket_rows=10)
        assert {r.k: (r.o, r.v) for r in snapshots.read(spark, path).collect()} == want and made.rows == len(want)
        again = snapshots.upsert(spark, path, df, ["k"], "o", batch=f"b{batch}", bucket_rows=10)
        assert again == made and len(snapshots.log(spark, path)) == batch + 1
    sizes = [s.buckets for s in snapshots.log(spark, path)]
    assert sizes == sorted(sizes) and sizes[-1] >= 8
    for b, folder in made.parts.items():
        own = spark.read.parquet(f"{path}/{folder}")
        assert own.select(snapshots.bucket(["k"], made.buckets)).distinct().collect()[0][0] == int(b)


def test_a_batch_rewrites_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "k")
    many = spark.range(400).select(F.col("id").alias("k"), F.lit(1).alias("o"))
    before = snapshots.upsert(spark, path, many, ["k"], "o", bucket_rows=40)
    after = snapshots.upsert(spark, path, many.where("k = 7").withColumn("o", F.lit(2)), ["k"], "o", bucket_rows=40)
    assert before.buckets == after.buckets and sum(after.parts[b] != before.parts[b] for b in before.parts) == 1
    assert snapshots.read(spark, path).where("o = 2").count() == 1 and after.rows == 400


def test_a_killed_batch_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "k")
    rows = spark.range(30).select(F.col("id").alias("k"), F.lit(1).alias("o"))
    snapshots.upsert(spark, path, rows, ["k"], "o", batch="1", bucket_rows=10)
    more = spark.range(20, 60).select(F.col("id").alias("k"), F.lit(2).alias("o"))
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            snapshots.upsert(spark, path, more, ["k"], "o", batch="2", bucket_rows=10)
    assert snapshots.read(spark, path).count() == 30
    assert snapshots.upsert(spark, path, more, ["k"], "o", batch="2", bucket_rows=10).rows == 60
    empty = snapshots.upsert(spark, str(tmp_path / "e"), rows.limit(0), ["k"], "o")
    assert empty.rows == 0 and snapshots.read(spark, str(tmp_path / "e")).count() == 0
