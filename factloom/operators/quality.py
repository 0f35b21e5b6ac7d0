"""The reviewed-patch workflow: queue, decisions, preflight, plan with gates, application with a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.streaming import snapshots
from factloom.sources.tables import cut


def change_type(action: Column) -> Column:
    return F.when(action.isin("annotate_kind", "annotate_precision", "add_alias"), "metadata_only").when(action.isin("replace_value", "fix_extraction"), "value_change").otherwise("manual_review")


def risk(change: Column, evidence_class: Column) -> Column:
    return (
        F.when((change == "value_change") | (evidence_class == "true_conflict"), "high")
        .when(evidence_class == "mass_granularity", "medium")
        .when(evidence_class == "kind_mismatch", "low")
        .otherwise("medium")
    )


def queue(candidates: DataFrame, packets: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Review items: candidates (patch_id, subject, relation, action) with their packet's class (left join by
    subject and relation), change type, risk, safe flag, and what was decided before (default pending)."""
    cls = packets.groupBy("subject", "relation").agg(F.max_by("evidence_class", "packet_no").alias("evidence_class"))
    items = candidates.join(cls, ["subject", "relation"], "left")
    items = items.withColumn("change_type", change_type(F.col("action"))).withColumn("risk_level", risk(F.col("change_type"), F.col("evidence_class")))
    items = items.withColumn("safe", (F.col("change_type") == "metadata_only") & F.col("risk_level").isin("low", "medium"))
    if decisions is None:
        return items.withColumn("human_decision", F.lit("pending"))
    return items.join(decisions.select("patch_id", F.col("human_decision").alias("_d")), "patch_id", "left").withColumn("human_decision", F.coalesce("_d", F.lit("pending"))).drop("_d")


def upsert_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """New decisions over old ones by patch_id; what is applied stays applied."""
    n = new.select("patch_id", F.col("human_decision").alias("_d"), F.col("human_reason").alias("_r"))
    met = old.join(n, "patch_id", "full_outer")
    done = F.coalesce(F.col("revision_status") == "applied", F.lit(False))
    return met.select(
        "patch_id",
        F.when(done, F.col("human_decision")).otherwise(F.coalesce("_d", "human_decision")).alias("human_decision"),
        F.when(done, F.col("human_reason")).otherwise(F.coalesce("_r", "human_reason")).alias("human_reason"),
        F.coalesce("revision_status", F.lit("none")).alias("revision_status"),
    )


def defer_high_risk(items: DataFrame) -> DataFrame:
    return items.withColumn("human_decision", F.when((F.col("risk_level") == "high") & (F.col("human_decision") == "pending"), "deferred").otherwise(F.col("human_decision")))


def reconcile(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(patch_id, problem): decisions without item, items without decision, approved but not safe."""
    i = items.select("patch_id", "safe").withColumn("_i", F.lit(True))
    d = decisions.select("patch_id", "human_decision").withColumn("_d", F.lit(True))
    met = i.join(d, "patch_id", "full_outer")
    problem = F.when(F.col("_i").isNull(), "unknown_item").when(F.col("_d").isNull(), "no_decision").when((F.col("human_decision") == "approved") & ~F.col("safe"), "approved_unsafe")
    return met.select("patch_id", problem.alias("problem")).where("problem is not null")


def preflight(records: DataFrame, changes: DataFrame) -> DataFrame:
    """For each change (patch_id, subject, relation, old_object, new_object): rows equal to the new value afterwards."""
    met = changes.join(records.select("subject", "relation", "object"), ["subject", "relation"], "left")
    after = F.when(F.col("object") == F.col("old_object"), F.col("new_object")).otherwise(F.col("object"))
    n = F.count_if(after == F.col("new_object"))
    return met.groupBy("patch_id").agg(n.alias("n_after"), (n > 1).alias("would_create_duplicate"))


def plan(items: DataFrame) -> DataFrame:
    """Each item's outcome: skipped, blocked (with what is wrong) or applied.

    Items: human_decision, human_reason, safe, action, approved_action, revision_status, change_type, allow_value_change.
    """
    value = F.col("change_type") == "value_change"
    wrong = F.array_compact(F.array(
        F.when(text.blank(F.col("human_reason")), "no_reason"),
        F.when(~F.col("safe") & ~value, "not_safe"),
        F.when(F.col("approved_action") != F.col("action"), "action_mismatch"),
        F.when(value & ~F.col("allow_value_change"), "value_change_not_allowed"),
        F.when(value & (F.col("revision_status") != "validated"), "revision_not_validated"),
    ))
    outcome = F.when(F.col("revision_status") == "applied", "skip_applied").when(F.col("human_decision") != "approved", F.concat(F.lit("skip_"), F.col("human_decision"))).when(F.size("errors") > 0, "blocked").otherwise("apply")
    return items.withColumn("errors", wrong).withColumn("outcome", outcome)


def apply_changes(records: DataFrame, changes: DataFrame) -> DataFrame:
    """The records with their objects replaced, of equal rows that the change made the first by ordinal; adds changed."""
    c = changes.select("subject", "relation", F.col("old_object").alias("object"), F.col("new_object").alias("_new"))
    met = records.join(c, ["subject", "relation", "object"], "left")
    rewritten = met.withColumn("changed", F.col("_new").isNotNull()).withColumn("object", F.coalesce("_new", "object")).drop("_new")
    keys = ["subject", "relation", "object", "source_name"]
    touched = rewritten.where("changed").select(*keys).distinct()
    once = rewritten.join(touched, keys, "left_semi").groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min_by(F.struct(*rewritten.columns), "ordinal").alias("_row")).select("_row.*")
    return rewritten.join(touched, keys, "left_anti").unionByName(once.select(*rewritten.columns))


def manifest(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: counts and order-free digests of both versions, to prove a change or roll it back."""
    columns = ("subject", "relation", "object", "source_name")
    digest = lambda df: df.agg(F.count("*").alias("n"), snapshots.digest(df, columns).alias("digest"))
    b, a = digest(before), digest(after)
    return b.select(F.col("n").alias("n_before"), F.col("digest").alias("digest_before")).crossJoin(a.select(F.col("n").alias("n_after"), F.col("digest").alias("digest_after")))


def external_review(values: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(patch_id, result): which source an outside number confirms within 1 %; a ratio of 100 or more is an extraction error.

    values: patch_id, external double, and the numbers of two sources (first, second).
    """
    near = lambda c: F.coalesce(F.abs(F.col("external") - c) <= tolerance * F.greatest(F.abs(F.col("external")), F.abs(c)), F.lit(False))
    a, b = near(F.col("first")), near(F.col("second"))
    far = F.greatest(F.col("first"), F.col("second")) >= 100 * F.least(F.col("first"), F.col("second"))
    return values.select("patch_id", F.when(far, "source_extraction_error").when(a & b, "precision_difference").when(a, "confirms_first").when(b, "confirms_second").otherwise("unresolved").alias("result"))


def with_external(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """The queue with the external review of each item, by the patch that it is about, and reviews of no patch as items of their own.

    queue: patch_id and more. reviews: review_id, source_patch_id, comparison_result, recommendation; of several for a patch the last by id counts.
    An independent item's patch_id is its review's id.
    """
    found = ["comparison_result", "recommendation"]
    of_patch = reviews.where(~text.blank(F.col("source_patch_id"))).groupBy(F.col("source_patch_id").alias("patch_id")).agg(*(F.max_by(c, "review_id").alias(c) for c in ("review_id", *found)))
    own = queue.join(of_patch, "patch_id", "left").withColumn("independent", F.lit(False))
    alone = reviews.where(text.blank(F.col("source_patch_id"))).select(F.col("review_id").alias("patch_id"), "review_id", *found, F.lit(True).alias("independent"))
    return own.unionByName(alone, allowMissingColumns=True)


def external_summary(reviews: DataFrame) -> DataFrame:
    """(kind, value, n): reviews by comparison result and by recommendation, those that need approval, and all."""
    pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")) for kind, value in (("comparison_result", F.col("comparison_result")), ("recommendation", F.col("recommendation")), ("requires_human_approval", F.when(F.col("requires_human_approval"), F.lit("true"))), ("reviewed", F.lit("all")))))
    return reviews.select(F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """The rows numbered from 1 within ``keys`` by ``order``, as ``name``.

    The rows are sorted by range, so a key with very many rows is spread over tasks; a task numbers its own, and what earlier
    ranges hold of the key is added.
    """
    by = [*keys, order]
    ranges = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))
    counts = ranges.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_rows")
    offsets = counts.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), F.col("_part").alias("_at"), before.alias("_before"))
    own = ranges.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return own.join(offsets, [*same, F.col("_part") == F.col("_at")]).withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


def unique_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """Ids that repeat get _2, _3, ... in order."""
    return numbered(df, [column], order, "_n").withColumn(column, F.when(F.col("_n") > 1, F.concat_ws("_", F.col(column), F.col("_n").cast("string"))).otherwise(F.col(column))).drop("_n")


def validate_revisions(revisions: DataFrame) -> DataFrame:
    """(patch_id, errors, valid) of proposed values: a value, a numeric one where a unit is given, a reason, and evidence where the risk is high."""
    number = F.col("user_proposed_value").try_cast("double")
    errors = F.array_compact(F.array(
        F.when(text.blank(F.col("user_proposed_value")), "no_value"),
        F.when(~text.blank(F.col("user_proposed_unit")) & number.isNull(), "value_not_numeric"),
        F.when(text.blank(F.col("user_revision_reason")), "no_reason"),
        F.when((F.col("risk_level") == "high") & text.blank(F.col("user_evidence_url")), "no_evidence"),
    ))
    return revisions.select("patch_id", errors.alias("errors")).withColumn("valid", F.size("errors") == 0)
