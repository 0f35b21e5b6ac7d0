"""Idempotent incremental loads: a file stream whose checkpoint knows what was read, upserted batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.streaming import snapshots


def load_new_files(spark: SparkSession, folder: str, schema: T.StructType | str, target: str, checkpoint: str, keys: Sequence[str], order: str, fmt: str = "parquet", bucket_rows: int = snapshots.BUCKET_ROWS, name_glob: str | None = None) -> int:
    """Read the files of ``folder`` (those named as ``name_glob``) that this checkpoint hasn't seen and upsert them into the keyed table ``target`` (``snapshots``).

    A batch rewrites only the buckets that it touches, and one that runs twice, or again after it was killed, changes nothing.
    Of rows with one key the greatest ``order`` stays. Returns the number of batches. Folder and checkpoint are on storage that all executors share.
    """
    done = 0

    def upsert(batch: DataFrame, number: int) -> None:
        nonlocal done
        done += 1
        snapshots.upsert(spark, target, batch, keys, order, batch=f"{checkpoint}#{number}", bucket_rows=bucket_rows)

    reader = spark.readStream.schema(schema).format(fmt)
    stream = (reader if name_glob is None else reader.option("pathGlobFilter", name_glob)).load(folder)
    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(day, event_type, n, total) of a stream or table of events (ts, event_type, value), with a watermark for late rows."""
    marked = events.withWatermark("ts", lateness) if events.isStreaming else events
    return marked.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def unseen(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: candidates whose key isn't done yet."""
    return candidates.join(done.select(key), key, "left_anti")
