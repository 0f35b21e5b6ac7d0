"""A corpus pipeline of five operators, each working on all that its predecessor kept.

Toxic documents go, one document of each group of near-duplicates stays, repeated passages are cut out,
documents contaminated with benchmark text go, and what is left is packed into training sequences. Every
stage but the last returns the columns of ``documents``. Extra columns, of any name, ride along untouched.

Defined results, for every stage: a null text counts as empty; repeated rows and repeated or null ids are rows like any
others; an empty table gives an empty one; texts of any length are used whole. Each stage says what that comes to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, packing, simhash, substring, textops, toxicity

#: SQL can't express the network, the fingerprints' hash or the packing; tests hold stages against brute force.
ORACLE_SQL = None


def _slim(docs: DataFrame) -> DataFrame:
    """Id and text, and all else in one column, so that no name can clash with an operator's."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None)).alias("_rest"))


def _whole(slim: DataFrame, docs: DataFrame) -> DataFrame:
    return slim.select(*(c if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores under its threshold.

    Null and empty texts score as an empty window, and repeated rows alike; without labels of both kinds nothing goes.
    """
    labels = textops.read(spark, sf_dir, "labels")
    return _whole(toxicity.score_toxicity(_slim(docs), labels).where(F.col("score") < toxicity.THRESHOLD), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the least id.

    Null and empty texts are copies of each other; of rows that share the least id one stays; a null id counts after all others.
    """
    return _whole(simhash.keep_one(_slim(docs)), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words in windows that occur again; n_chars follows a changed text.

    Null texts stay null and unchanged texts keep their white space; rows that repeat lose what they share.
    """
    found = substring.substring_dedup(_slim(docs), keep=["doc_id", "_rest"])
    changed = F.col("n_removed") > 0
    out = found.select("doc_id", F.col("kept").alias("text"), "_rest", changed.alias("_changed"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("_changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_rest")["n_chars"])
        out = out.withColumn("_rest", F.col("_rest").withField("n_chars", n))
    return _whole(out, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which under a twentieth of the words is benchmark text.

    Null and empty texts stay; with an empty benchmark all do. Ties (exactly a twentieth) go.
    """
    found = decontaminate.decontaminate(_slim(docs), textops.read(spark, sf_dir, "benchmark"))
    return _whole(found.where(~F.col("contaminated")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences.

    A null or empty text is a piece of its end alone; repeated rows are packed one by one.
    """
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages a table in the shared folder cuts the lineage."""
    textops.shared_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = textops.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
