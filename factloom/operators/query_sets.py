"""Question sets for evaluating a source: candidates of every kind from its facts and chunks, and a sample with a quota for each kind.

The sample of a kind are its candidates with the least hashes (bottom-k). The hash is md5 of seed and id, so a set can be made again anywhere.
Candidates are counted by the beginnings of their hashes first; only those whose beginning can be among the least are put in order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.sources.tables import cut

#: Hexadecimal digits of a hash's beginning.
DIGITS = 3

#: (source_name, kind, id, question, subject, relation, object, section, expects, path)
FIELDS = ("source_name", "kind", "id", "question", "subject", "relation", "object", "section", "expects", "path")


def _question(forms: Mapping[str, str], subject: Column, relation: Column) -> Column:
    """A relation's form with {s} filled in; without a form subject and relation."""
    return F.replace(text.mapped(relation, forms, F.concat(F.lit("{s} "), relation)), F.lit("{s}"), subject)


def candidates(facts: DataFrame, chunks: DataFrame, forms: Mapping[str, str], quantities: tuple[str, ...] = ("HAS_MASS", "HAS_RADIUS")) -> DataFrame:
    """What each source may be asked, by kind:

    structured: its facts; unit_normalization: its quantities, answers without blanks and case; conflict_case: subjects of which it says several things under one relation;
    negative: subjects that it knows with a relation that it never gives them; source_isolation: facts that only other sources have, to which it has no
    answer; narrative: its chunks (source_name, title, section). expects says whether an answer is to be found.
    """
    keys = ("source_name", "subject", "relation")
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, kind: str, obj: Column, expects: bool, path: str = "graph") -> DataFrame:
        who = F.sha2(F.concat_ws("|", "source_name", F.lit(kind), "subject", "relation", F.coalesce(obj, F.lit(""))), 256)
        return df.select("source_name", F.lit(kind).alias("kind"), F.substring(who, 1, 16).alias("id"), _question(forms, F.col("subject"), F.col("relation")).alias("question"), "subject", "relation", obj.alias("object"), none.alias("section"), F.lit(expects).alias("expects"), F.lit(path).alias("path"))

    # Written once, as every kind is made from it.
    said = cut(facts.where("subject is not null and relation is not null and source_name is not null").groupBy(*keys).agg(F.min("object").alias("object"), (F.min("object") != F.max("object")).alias("several")))
    measured = F.col("relation").isin(*quantities)
    out = rows(said.where(~measured), "structured", F.col("object"), True)
    out = out.unionByName(rows(said.where(measured), "unit_normalization", text.quantity_key(F.col("object")), True))
    out = out.unionByName(rows(said.where("several"), "conflict_case", F.col("object"), True))
    # Every subject of a source with the first of the source's relations that it lacks; a source's relations are few.
    relations = said.groupBy("source_name").agg(F.array_sort(F.collect_set("relation")).alias("_all"))
    lacking = said.groupBy("source_name", "subject").agg(F.collect_set("relation").alias("_own")).join(F.broadcast(relations), "source_name").withColumn("relation", F.try_element_at(F.array_except("_all", "_own"), F.lit(1)))
    out = out.unionByName(rows(lacking.where("relation is not null"), "negative", none, False))
    # A fact of one source only, asked of the source next in the alphabet (the last asks the first).
    names = said.select("source_name").distinct().withColumn("_next", F.coalesce(F.lead("source_name").over(Window.orderBy("source_name")), F.first("source_name").over(Window.orderBy("source_name"))))
    single = said.groupBy("subject", "relation").agg(F.min("source_name").alias("source_name"), F.max("source_name").alias("_last")).where("source_name = _last")
    asked = single.join(F.broadcast(names), "source_name").where("_next <> source_name").select(F.col("_next").alias("source_name"), "subject", "relation")
    out = out.unionByName(rows(asked, "source_isolation", none, False))
    told = chunks.where("title is not null and source_name is not null").groupBy("source_name", "title").agg(F.min("section").alias("section"))
    who = F.substring(F.sha2(F.concat_ws("|", "source_name", F.lit("narrative"), "title"), 256), 1, 16)
    told = told.select("source_name", F.lit("narrative").alias("kind"), who.alias("id"), F.concat_ws(" ", "title", "section").alias("question"), F.col("title").alias("subject"), none.alias("relation"), none.alias("object"), "section", F.lit(True).alias("expects"), F.lit("fallback").alias("path"))
    return out.unionByName(told)


def query_set(asked: DataFrame, quotas: Mapping[str, int], seed: str = "v2") -> DataFrame:
    """Of each source and kind the ``quotas[kind]`` candidates with the least hashes, with their place; kinds without a quota are left out."""
    if not quotas:
        return asked.withColumn("place", F.lit(0)).where(F.lit(False))
    kinds = ("source_name", "kind")
    quota = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair)), F.col("kind")), F.lit(0))
    hashed = asked.where(quota > 0).withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}|"), "id").cast("binary"))).withColumn("_begin", F.coalesce(F.substring("_hash", 1, DIGITS), F.lit("")))
    counts = hashed.groupBy(*kinds, "_begin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*kinds).orderBy("_begin")) - F.col("_n")
    ends = counts.withColumn("_before", before).where(F.col("_before") < quota).groupBy(*(F.col(k).alias(f"_{k}") for k in kinds)).agg(F.max("_begin").alias("_end"))
    least = hashed.join(F.broadcast(ends), F.col("source_name").eqNullSafe(F.col("_source_name")) & (F.col("kind") == F.col("_kind")) & (F.col("_begin") <= F.col("_end")))
    place = F.row_number().over(Window.partitionBy(*kinds).orderBy("_hash", "id"))
    return least.withColumn("place", place).where(F.col("place") <= quota).select(*asked.columns, "place")


def shortfalls(chosen: DataFrame, sources: DataFrame, quotas: Mapping[str, int]) -> DataFrame:
    """(source_name, kind, quota, n) where a source (source_name) has fewer questions of a kind than its quota."""
    wanted = sources.select("source_name").distinct().select("source_name", F.explode(F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))).alias("kind", "quota"))
    n = chosen.groupBy("source_name", "kind").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, ["source_name", "kind"], "left").select("source_name", "kind", "quota", F.coalesce("n", F.lit(0)).alias("n")).where("n < quota")
