"""Tables as snapshots: every change writes new folders and then one entry of a log that says which folders the table is.

An entry is made exclusively and whole or not at all, so a change that fails on the way leaves the table as it was, readers never see half of
one, and of two writers one gets an error. Restoring is an entry that names an older version's folders.

Keyed tables lie in buckets by a hash of the key, and the number of buckets grows with the rows (linear hashing): bucket n divides the rows of
one bucket before it, so a growing table rewrites the buckets that a batch touches and those that divide, at any size. A batch that the log
already has changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.triples import first_of

#: Rows of a bucket, in the mean, beyond which buckets divide.
BUCKET_ROWS = 1_000_000


@dataclass(frozen=True)
class Snapshot:
    """An entry of the log; parts: folder of each bucket, within the table's."""

    version: int
    parts: dict[str, str] = field(default_factory=dict)
    buckets: int = 1
    rows: int = 0
    digest: str = ""
    note: str = ""
    batch: str = ""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def log(spark: SparkSession, path: str) -> list[Snapshot]:
    """All versions, oldest first."""
    top, fs = _path(spark, f"{path}/log")
    if not fs.exists(top):
        return []
    out = []
    for name in sorted(s.getPath().toString() for s in fs.listStatus(top) if s.getPath().getName().endswith(".json")):
        stream = fs.open(_path(spark, name)[0])
        try:
            out.append(Snapshot(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
        finally:
            stream.close()
    return out


def current(spark: SparkSession, path: str) -> Snapshot:
    """The newest version; version 0 without parts before the first."""
    found = log(spark, path)
    return found[-1] if found else Snapshot(0)


def _commit(spark: SparkSession, path: str, snapshot: Snapshot) -> Snapshot:
    """Make the entry, under a name of its own first; an error if that version is there already."""
    final, fs = _path(spark, f"{path}/log/{snapshot.version:09d}.json")
    own = _path(spark, f"{path}/log/{uuid.uuid4().hex}.writing")[0]
    stream = fs.create(own, False)
    try:
        stream.write(bytearray(json.dumps(asdict(snapshot)).encode()))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(own, final):
        fs.delete(own, False)
        raise ValueError(f"version {snapshot.version} of {path} is there already")
    return snapshot


def digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """Aggregate: count and sum of the rows' md5 prefixes, the same in any order."""
    row = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary"))
    return F.concat_ws(":", F.count(F.lit(1)), F.coalesce(F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string"))


def _folders(path: str, parts: dict[str, str]) -> list[str]:
    return [f"{path}/{folder}" for folder in parts.values()]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table, as it is or as it was."""
    found = current(spark, path) if version is None else next((s for s in log(spark, path) if s.version == version), Snapshot(0))
    if not found.version:
        raise ValueError(f"no version {version} of {path}")
    folders = _folders(path, found.parts)
    return spark.read.parquet(*folders) if folders else spark.read.parquet(f"{path}/empty")


def _measured(df: DataFrame) -> tuple[int, str]:
    n, text = df.agg(F.count(F.lit(1)), digest(df, sorted(df.columns))).first()
    return n, text


def publish(spark: SparkSession, path: str, df: DataFrame, note: str = "") -> Snapshot:
    """The whole table anew, as one part."""
    last = current(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    rows, text = _measured(spark.read.parquet(f"{path}/{folder}"))
    return _commit(spark, path, Snapshot(last.version + 1, {"0": folder}, 1, rows, text, note))


def restore(spark: SparkSession, path: str, version: int, note: str = "") -> Snapshot:
    """A new version that is an older one again."""
    old = next(s for s in log(spark, path) if s.version == version)
    return _commit(spark, path, Snapshot(current(spark, path).version + 1, old.parts, old.buckets, old.rows, old.digest, note or f"restored {version}"))


def bucket(keys: Sequence[str], buckets: int) -> Column:
    """Linear hashing: the hash modulo the next power of two, or where that bucket isn't there yet modulo the one before."""
    high = 1 << buckets.bit_length()
    h = F.xxhash64(*keys)
    wide = F.pmod(h, F.lit(high))
    return F.when(wide < buckets, wide).otherwise(F.when(F.pmod(h, F.lit(high // 2)) < buckets, F.pmod(h, F.lit(high // 2))).otherwise(F.pmod(h, F.lit(high // 4 or 1)))).cast("int")


def divided_from(number: int, buckets: int) -> int:
    """Of which of the first ``buckets`` buckets a later one takes its rows."""
    while number >= buckets:
        number -= 1 << (number.bit_length() - 1)
    return number


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], order: str, *, batch: str = "", bucket_rows: int = BUCKET_ROWS, note: str = "") -> Snapshot:
    """Merge rows by key, of equal keys the greatest ``order``; a batch that the log has already is skipped."""
    past = log(spark, path)
    if batch and (done := next((s for s in past if s.batch == batch), None)):
        return done
    last = past[-1] if past else Snapshot(0)
    expected = max(last.rows, rows.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0])
    buckets = max(last.buckets, -(-expected // bucket_rows))
    touched = {r[0] for r in rows.select(bucket(keys, last.buckets)).distinct().collect()} | {divided_from(b, last.buckets) for b in range(last.buckets, buckets)}
    old = {str(b): last.parts[str(b)] for b in touched if str(b) in last.parts}
    merged = rows
    if old:
        merged = rows.unionByName(spark.read.parquet(*_folders(path, old)).select(*rows.columns))
    folder = f"data-{uuid.uuid4().hex}"
    merged = first_of(merged, keys, order, last=True).withColumn("key_bucket", bucket(keys, buckets))
    merged.write.partitionBy("key_bucket").parquet(f"{path}/{folder}")
    top, fs = _path(spark, f"{path}/{folder}")
    made = {name.partition("=")[2]: f"{folder}/{name}" for name in (s.getPath().getName() for s in fs.listStatus(top)) if name.startswith("key_bucket=")}
    parts = {b: f for b, f in last.parts.items() if int(b) not in touched} | made
    if not parts:
        rows.limit(0).write.mode("overwrite").parquet(f"{path}/empty")
    n = spark.read.parquet(*_folders(path, parts)).count() if parts else 0
    return _commit(spark, path, Snapshot(last.version + 1, parts, buckets, n, "", note, batch))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the folders that none of the ``keep`` newest versions has, and the older entries; returns how many folders went."""
    past = log(spark, path)
    kept = {folder.split("/")[0] for s in past[-keep:] for folder in s.parts.values()}
    top, fs = _path(spark, path)
    gone = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in kept]
    for s in past[:-keep]:
        fs.delete(_path(spark, f"{path}/log/{s.version:09d}.json")[0], False)
    for p in gone:
        fs.delete(p, True)
    return len(gone)
