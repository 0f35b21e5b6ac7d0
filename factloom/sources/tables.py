"""Readers and writers of sources: JSON and parquet scans, adapters, sinks, namespaces, checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schemas
from factloom.functions import text


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: the cluster's, or one of our own where none is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            import tempfile

            found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(found)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path among the checkpoints, which all machines share."""
    shared_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of files that hold a JSON array (or one object) each, with file (path) and ordinal: by file name, then position.

    A file is one row until its array is taken apart, so a record's position is its own, however Spark deals files over tasks.
    """
    files = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    as_array = F.when(F.ltrim("value").startswith("{"), F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value"))
    rows = files.select("file", F.posexplode(F.from_json(as_array, T.ArrayType(schema))).alias("position", "record")).where("record is not null")
    names = files.select("file").distinct().withColumn("number", F.row_number().over(Window.orderBy("file")))
    return rows.join(names, "file").select("record.*", "file", (F.shiftleft(F.col("number").cast("long"), 32) + F.col("position")).alias("ordinal"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of triples; the file's name without its suffix is the title, (file, position) the ordinal's order.

    Unreadable files give no rows.
    """
    rows = _json_rows(spark, path, _struct(schemas.TRIPLE))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(_triples)?\.json$", "")
    return rows.withColumn("file_title", F.url_decode(name)).drop("file")


def read_narratives(spark: SparkSession, path: str, least: int = 40) -> DataFrame:
    """Chunks with at least ``least`` characters of content."""
    return _json_rows(spark, path, _struct(schemas.NARRATIVE)).where(F.length("content") >= least).drop("file")


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(triples, narratives) of a fixture bundle, with the bundle's source and the record's title."""
    records = spark.read.schema(schemas.BUNDLE).option("multiLine", True).json(path).select("source_name", F.posexplode("records").alias("record_no", "record"))
    triples = records.select("source_name", F.col("record.title").alias("source_title"), "record_no", F.posexplode("record.triples").alias("pos", "t"))
    chunks = records.select("source_name", F.col("record.title").alias("source_title"), "record_no", F.posexplode("record.narratives").alias("pos", "n"))
    return triples.select("source_name", "source_title", "record_no", "pos", "t.*"), chunks.select("source_name", "source_title", "record_no", "pos", "n.*")


def read_claims(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """(entity_id, label, property_id, relation, value) from entity JSON: entities, claims, main values.

    Values are amount and unit id, an id, a text, a time or a scalar, whichever comes first.
    """
    top = spark.read.schema(schemas.CLAIMS).option("multiLine", True).json(path)
    entities = top.select(F.explode("entities").alias("entity_id", "e"))
    label = F.coalesce(*(F.try_element_at("e.labels", F.lit(lang))["value"] for lang in ("zh-hans", "zh", "en")), F.col("entity_id"))
    claims = entities.select("entity_id", label.alias("label"), F.explode("e.claims").alias("property_id", "claims"))
    rows = claims.where(F.col("property_id").isin(*properties)).select("entity_id", "label", "property_id", F.posexplode("claims").alias("pos", "c"))
    v = F.col("c.mainsnak.datavalue.value")
    get = lambda k: F.nullif(F.get_json_object(v, f"$.{k}"), F.lit(""))
    unit = F.nullif(F.regexp_extract(F.coalesce(get("unit"), F.lit("")), r"(Q\d+)$", 1), F.lit(""))
    value = F.coalesce(F.when(get("amount").isNotNull(), F.concat_ws(" ", F.regexp_replace(get("amount"), r"^\+", ""), unit)), get("id"), get("text"), get("time"), v)
    return rows.select("entity_id", "label", "property_id", text.mapped(F.col("property_id"), properties).alias("relation"), value.alias("value"), "pos").where(~text.blank(F.col("value")))


def fill_from(records: DataFrame, fixtures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records, and of the fixtures those whose key the records lack."""
    return records.unionByName(fixtures.join(records.select(*keys).distinct(), list(keys), "left_anti"))


def override(records: DataFrame, fixtures: DataFrame, keys: Sequence[str], column: str, order: str | None = None) -> DataFrame:
    """Records with ``column`` replaced where a fixture has a value for the key, and the fixtures' missing keys.

    Of several fixtures for a key the first by ``order`` that has a value counts; without an order, the one of least value.
    """
    by = F.col(order or column)
    given = fixtures.groupBy(*keys).agg(F.min_by(column, F.when(F.col(column).isNotNull(), by)).alias("_given"))
    changed = records.join(given, list(keys), "left").withColumn(column, F.coalesce("_given", column)).select(*records.columns)
    return changed.unionByName(fixtures.join(records.select(*keys).distinct(), list(keys), "left_anti").select(*records.columns))


def write_namespaced(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite only the sources that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_name").format(fmt).save(path)


def append_new(df: DataFrame, existing: DataFrame | None, path: str, key: str) -> DataFrame:
    """Append the rows whose key is new, one for each key; returns them."""
    fresh = df.dropDuplicates([key]) if existing is None else df.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def with_chunk_id(df: DataFrame) -> DataFrame:
    """The given id, or 12 hex digits of the content's md5."""
    return df.withColumn("chunk_id", text.filled(F.col("chunk_id") if "chunk_id" in df.columns else F.lit(None).cast("string"), text.short_id(F.col("content"))))


def collect_offline(offline: DataFrame, live: DataFrame | None, mode: str) -> DataFrame:
    """Adapter contract: 'live' takes live rows where there are any and falls back to offline ones; other modes are offline."""
    if mode != "live" or live is None or live.isEmpty():
        return offline.withColumn("fetched_by", F.lit("offline"))
    return live.withColumn("fetched_by", F.lit("live"))
