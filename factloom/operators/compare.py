"""Two sources' first answers compared: kinds of conflict, and the stated quantities in which texts differ.

A claim is a number with a unit or a percentage. Two texts' claims are compared as multisets; what one side says more often is its surplus, and each surplus
claim is set beside the nearest value of the same unit in the other's surplus. Values of a key and unit are sorted once with both sides
among each other, and each looks to its neighbours, so no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text

_CLAIM = r"\d+(?:\.\d+)?\s*(?:%|％|[A-Za-z]{1,12}|\p{IsHan}{1,4})"


def _same(a: Column, b: Column) -> Column:
    """Equal but for white space; null counts as empty."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return plain(a) == plain(b)


def structured_status(left: Column, right: Column) -> Column:
    """Of two facts (structs with subject, relation, object; null: none): none, missing_on_one_side, topic_mismatch or structured_value_conflict."""
    topic = _same(left["subject"], right["subject"]) & _same(left["relation"], right["relation"])
    one = F.when(left.isNull() & right.isNull(), "none").when(left.isNull() | right.isNull(), "missing_on_one_side")
    return one.when(~topic, "topic_mismatch").when(~_same(left["object"], right["object"]), "structured_value_conflict").otherwise("none")


def narrative_status(left: Column, right: Column) -> Column:
    """Of two chunks (structs with page_title, section, content): none, missing_on_one_side, topic_mismatch, numeric_claim_divergence or content_variation."""
    topic = _same(left["page_title"], right["page_title"]) & _same(left["section"], right["section"])
    one = F.when(left.isNull() & right.isNull(), "none").when(left.isNull() | right.isNull(), "missing_on_one_side")
    claims = text.percent_claims(left["content"]) != text.percent_claims(right["content"])
    return one.when(~topic, "topic_mismatch").when(claims, "numeric_claim_divergence").when(~_same(left["content"], right["content"]), "content_variation").otherwise("none")


def first_answers(rows: DataFrame, probe: str, columns: Sequence[str], left: str, right: str, order: str) -> DataFrame:
    """(probe, left, right): each source's first row for each probe as a struct; a source that has none gives null."""
    pick = lambda source: F.min_by(F.when(F.col("source_name") == source, F.struct(*columns)), F.when(F.col("source_name") == source, F.col(order)))
    return rows.where(F.col("source_name").isin(left, right)).groupBy(probe).agg(pick(left).alias("left"), pick(right).alias("right"))


def claims(c: Column) -> Column:
    """array<struct<value, unit>> of all quantities that a text states, in order; units in lower case, both signs of a percentage as one."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_CLAIM), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^[\d.]+", 0).cast("double").alias("value"), F.replace(F.lower(F.regexp_extract(m, r"[^\d.\s]+$", 0)), F.lit("％"), F.lit("%")).alias("unit")))


def claim_counts(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, unit, value, n): how often each claim is made under a key."""
    return rows.select(*keys, F.explode(claims(F.col(column))).alias("c")).groupBy(*keys, F.col("c.unit").alias("unit"), F.col("c.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def claim_divergence(rows: DataFrame, keys: Sequence[str], column: str, left: str, right: str) -> DataFrame:
    """(keys, unit, value, side, surplus, nearest, gap) of every claim that one of two sources makes more often than the other.

    nearest: the value of the same unit next to it in the other's surplus (of two as near the smaller), null without one; gap: their
    distance as a share of the larger.
    """
    counted = claim_counts(rows.where(F.col("source_name").isin(left, right)), [*keys, "source_name"], column)
    more = F.sum(F.when(F.col("source_name") == left, F.col("n")).otherwise(-F.col("n")))
    surplus = counted.groupBy(*keys, "unit", "value").agg(more.alias("more")).where("more <> 0")
    sided = surplus.select(*keys, "unit", "value", F.when(F.col("more") > 0, left).otherwise(right).alias("side"), F.abs("more").alias("surplus"))
    line = Window.partitionBy(*keys, "unit").orderBy("value")
    below, above = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    of = lambda side: F.when(F.col("side") == side, F.col("value"))
    reach = {f"_{name}_{i}": (F.last if name == "below" else F.first)(of(side), ignorenulls=True).over(frame) for name, frame in (("below", below), ("above", above)) for i, side in enumerate((left, right))}
    met = sided.withColumns(reach)
    other = lambda name: F.when(F.col("side") == left, F.col(f"_{name}_1")).otherwise(F.col(f"_{name}_0"))
    low, high, value = other("below"), other("above"), F.col("value")
    nearest = F.when(low.isNull(), high).when(high.isNull() | (value - low <= high - value), low).otherwise(high)
    gap = F.abs(F.col("nearest") - value) / F.greatest(F.abs("nearest"), F.abs(value))
    return met.withColumn("nearest", nearest).select(*keys, "unit", "value", "side", "surplus", "nearest", gap.alias("gap"))
