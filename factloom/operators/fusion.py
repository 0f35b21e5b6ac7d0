"""Facts of several sources: agreement, near values, kinds, conflicts, authority, merging of candidates.

Groups are never collected whole: a group's status comes from aggregates (its first record, extremes, counts,
the few kinds and sources), which meet the records again by an equi-join that may split a hot group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import dims
from factloom.functions import entity, quantity, text
from factloom.sources.tables import cut

KEY = ("subject", "relation")
AGREED = "multi_source_agreement"


def _threshold(relation: Column, thresholds: Mapping[str, float], default: float) -> Column:
    out = F.lit(default)
    for r, t in thresholds.items():
        out = F.when(relation == r, t).otherwise(out)
    return out


def _valued(records: DataFrame, value: Column | None, kind: Column | None) -> DataFrame:
    """The records with a usable key, with their ``_value`` and ``_kind``."""
    kind = entity.measurement_kind(F.col("relation"), F.col("object"), F.col("source_title"), F.col("source_field"))["kind"] if kind is None else kind
    rows = records.where(~text.blank(F.col("subject")) & ~text.blank(F.col("relation"))).withColumn("_kind", kind)
    return quantity.with_value(rows, F.col("object"), F.col("relation"), "_value") if value is None else rows.withColumn("_value", value)


def _heads(rows: DataFrame, thresholds: Mapping[str, float], near_default: float, *more: Column) -> DataFrame:
    """One row for each key: fusion_status, n_records, sources, and ``more`` aggregates."""
    v = lambda part: F.col(f"_value.{part}")
    usable = (v("normalized_unit") != "") & v("numeric_value").isNotNull()
    known = F.when(F.col("_kind") != "unknown", F.col("_kind"))
    head = rows.groupBy(*KEY).agg(
        F.min_by(F.struct(v("numeric_value")), "ordinal").alias("_first"),
        F.count("*").alias("n_records"),
        F.count(v("numeric_value")).alias("_numbers"),
        F.min(v("numeric_value")).alias("_low"),
        F.max(v("numeric_value")).alias("_high"),
        # Extremes of texts and units tell whether all records are equal, without a second look at them.
        F.min(F.struct(v("normalized_value"))).alias("_least"),
        F.max(F.struct(v("normalized_value"))).alias("_most"),
        F.min(v("normalized_unit")).alias("_unit"),
        F.max(v("normalized_unit")).alias("_last_unit"),
        F.count_if(usable).alias("_usable"),
        F.coalesce(F.min(known) != F.max(known), F.lit(False)).alias("_kinds"),
        F.array_sort(F.collect_set(F.nullif(F.trim("source_name"), F.lit("")))).alias("sources"),
        *more,
    )
    first = F.col("_first.numeric_value")
    one_unit = (F.col("_usable") == F.col("n_records")) & (F.col("_unit") == F.col("_last_unit"))
    numbers_agree = quantity.close(first, F.col("_low"), dims.AGREE_TOLERANCE) & quantity.close(first, F.col("_high"), dims.AGREE_TOLERANCE)
    texts_agree = (F.col("_least.normalized_value") != "") & (F.col("_least.normalized_value") == F.col("_most.normalized_value"))
    # Equal numbers in one unit; where a record has no unit or number, or another unit, equal texts.
    agree = F.coalesce(F.when(one_unit, numbers_agree).otherwise(texts_agree), F.lit(False))
    near = (F.col("_numbers") == F.col("n_records")) & (quantity.relative_difference(F.col("_low"), F.col("_high")) <= _threshold(F.col("relation"), thresholds, near_default))
    status = (
        F.when((F.col("n_records") >= 2) & agree, AGREED)
        .when(F.col("_kinds"), "same_quantity_different_measurement_kind")
        .when((F.col("n_records") >= 2) & near, "near_equivalent_values")
        .when(F.col("n_records") >= 2, "human_review_required")
        .otherwise("single_source_only")
    )
    return head.withColumn("fusion_status", status)


def fuse(records: DataFrame, *, value: Column | None = None, kind: Column | None = None, thresholds: Mapping[str, float] = dims.NEAR_THRESHOLDS, near_default: float = dims.NEAR_DEFAULT) -> DataFrame:
    """The records with a usable key, and their group's fusion_status, n_records, sources and source_count.

    In this order: all equal the first record within 1e-9 (multi_source_agreement), two or more known
    measurement kinds, all numeric and near, otherwise several (human_review_required), or a single one.
    """
    rows = _valued(records, value, kind)
    met = rows.join(_heads(rows, thresholds, near_default).select(*KEY, "fusion_status", "n_records", "sources"), list(KEY))
    return met.withColumns({"measurement_kind": F.col("_kind"), "source_count": F.size("sources")}).select(*records.columns, "fusion_status", "measurement_kind", "n_records", "sources", "source_count")


def fused_table(records: DataFrame, columns: Sequence[str], *, value: Column | None = None, kind: Column | None = None, thresholds: Mapping[str, float] = dims.NEAR_THRESHOLDS, near_default: float = dims.NEAR_DEFAULT) -> DataFrame:
    """``columns`` of ``fused_records(fuse(records))``, with fusion_status: a group's first record comes with its status, so only others meet their group."""
    rows = _valued(records, value, kind)
    row = F.min_by(F.struct(*columns), "ordinal").alias("_row")
    # Written once, as both parts read it.
    heads = cut(_heads(rows, thresholds, near_default, row).select(*KEY, "fusion_status", F.when(F.col("fusion_status") == AGREED, F.col("_row")).alias("_row")))
    agreed = heads.where(F.col("fusion_status") == AGREED).select("_row.*", "fusion_status")
    others = rows.join(heads.where(F.col("fusion_status") != AGREED).select(*KEY, "fusion_status"), list(KEY))
    return others.select(*columns, "fusion_status").unionByName(agreed)


def fused_records(fused: DataFrame) -> DataFrame:
    """The fused table: of an agreement its first record, of all others every record."""
    merged = fused.where("fusion_status = 'multi_source_agreement'")
    first = merged.groupBy(*KEY).agg(F.min_by(F.struct(*merged.columns), "ordinal").alias("_row")).select("_row.*")
    return fused.where("fusion_status <> 'multi_source_agreement'").unionByName(first)


def summary(fused: DataFrame) -> DataFrame:
    """Groups and records of each status."""
    groups = fused.groupBy(*KEY, "fusion_status").agg(F.count("*").alias("n"))
    return groups.groupBy("fusion_status").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_records"))


def conflicts(records: DataFrame) -> DataFrame:
    """Keys with more than one distinct object: (subject, relation, n_objects, n_sources)."""
    counts = records.groupBy(*KEY).agg(F.count_distinct("object").alias("n_objects"), F.count_distinct("source_name").cast("int").alias("n_sources"))
    return counts.where("n_objects > 1")


def conflict_values(records: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each value of the conflicting keys, with its sources in order."""
    per = records.join(keys.select(*KEY), list(KEY), "left_semi").groupBy(*KEY, "object")
    return per.agg(F.array_join(F.array_sort(F.collect_set("source_name")), ",").alias("value_sources"), F.count("*").alias("n_records"))


def authority_table(spark: SparkSession, orders: Mapping[str, Sequence[str]] = dims.AUTHORITY_BY_RELATION) -> DataFrame:
    """(relation, source_name, authority_rank) of the sources' orders by relation."""
    rows = [(r, s, i + 1) for r, sources in orders.items() for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "relation string, source_name string, authority_rank int")


def rank_sources(records: DataFrame, authority: DataFrame, unknown: int) -> DataFrame:
    """Adds authority_rank (unknown sources last), authority (the key's best source, ties by name), is_authority."""
    ranked = records.join(F.broadcast(authority), ["relation", "source_name"], "left").withColumn("authority_rank", F.coalesce("authority_rank", F.lit(unknown)))
    best = ranked.groupBy(*KEY).agg(F.min(F.struct("authority_rank", "source_name")).alias("_best"))
    out = ranked.join(best, list(KEY)).withColumn("authority", F.col("_best.source_name"))
    return out.withColumn("is_authority", F.col("source_name") == F.col("authority")).select(*records.columns, "authority_rank", "authority", "is_authority")


def chunk_key(chunk_id: Column, title: Column, section: Column, content: Column) -> Column:
    """A chunk's id, or where it has none its title, section and the first 80 signs of its content."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.when(~text.blank(chunk_id), chunk_id).otherwise(F.concat_ws("::", part(title), part(section), F.substring(part(content), 1, 80)))


def merge_candidates(first: DataFrame, second: DataFrame, key: str, score: str) -> DataFrame:
    """Full outer by key: the greatest score, and each other field from the first list that has it non-blank."""
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in (key, score, "_list")]
    picks = [F.min_by(c, F.when(~text.blank(F.col(c).cast("string")), F.col("_list"))).alias(c) for c in others]
    return both.groupBy(key).agg(F.max(score).alias(score), *picks)
