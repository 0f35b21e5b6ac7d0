"""Evaluation of answers against gold sets: matches, failure classes, summaries, gates, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_index(results: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(query_id, match_rank): the first rank whose row is among the expected rows of its query."""
    hit = results.join(expected.select("query_id", *keys).distinct(), ["query_id", *keys], "left_semi")
    return hit.groupBy("query_id").agg(F.min("rank").alias("match_rank"))


def failure(rules: Sequence[tuple[Column, str]], otherwise: str = "pass") -> Column:
    """The first rule that holds names the failure."""
    out = None
    for condition, name in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(otherwise)


def summary(results: DataFrame, expects_hit: Column, hit: Column) -> DataFrame:
    """Totals and rates to four digits; the top-k rate counts only queries that expect a hit."""
    return results.agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("failure") == "pass").alias("n_passed"),
        F.round(F.avg((F.col("failure") == "pass").cast("double")), 4).alias("exact_accuracy"),
        F.round(F.avg(F.when(expects_hit, hit.cast("double"))), 4).alias("top_k_hit_rate"),
    )


def by_category(results: DataFrame) -> DataFrame:
    """(category, failure, n) with totals: null stands for all of a column."""
    return results.rollup("category", "failure").agg(F.count("*").alias("n"))


def gates(summary_row: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """(gate, value, bound, passed) for each least and greatest allowed value."""
    rows = [F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("value"), F.lit(float(b)).alias("bound"), (F.col(g) >= b).alias("passed")) for g, b in least.items()]
    rows += [F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("value"), F.lit(float(b)).alias("bound"), (F.col(g) <= b).alias("passed")) for g, b in most.items()]
    return summary_row.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def confusion(results: DataFrame, truth: str, guess: str) -> DataFrame:
    return results.groupBy(truth, guess).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def freshness(df: DataFrame, keys: Sequence[str], ts: str, most: str) -> DataFrame:
    """(keys, latest, stale): whether a key's latest row is older than the newest of all by more than an interval like '1 day'."""
    latest = df.groupBy(*keys).agg(F.max(ts).alias("latest"))
    newest = latest.agg(F.max("latest").alias("_newest"))
    return latest.crossJoin(F.broadcast(newest)).select(*keys, "latest", (F.col("latest") < F.col("_newest") - F.expr(f"interval {most}")).alias("stale"))


def triage(df: DataFrame, rules: Sequence[tuple[Column, str, str, int]]) -> DataFrame:
    """Adds flags (of all rules that hold), and owner and priority of the first; rules are (condition, flag, owner, priority)."""
    flags = F.array_compact(F.array(*(F.when(c, F.lit(f)) for c, f, _, _ in rules)))
    owner, priority = F.lit("none"), F.lit(0)
    for c, _, o, p in reversed(rules):
        owner, priority = F.when(c, o).otherwise(owner), F.when(c, p).otherwise(priority)
    return df.withColumns({"flags": flags, "owner": owner, "priority": priority})


def known_issues(issues: DataFrame, results: DataFrame) -> DataFrame:
    """Known issues with their status in a run: resolved or open by the run's consistency_match, not_observed where the run lacks them."""
    seen = results.groupBy("id").agg(F.bool_and(F.coalesce("consistency_match", F.lit(False))).alias("_ok"))
    status = F.when(F.col("_ok").isNull(), "not_observed").when(F.col("_ok"), "resolved").otherwise("open")
    return issues.join(seen, "id", "left").withColumn("status", status).withColumn("observed", F.col("_ok").isNotNull()).drop("_ok")


def load_summary(triples: DataFrame, narratives: DataFrame, file: str) -> DataFrame:
    """(source_name, total_triples, total_narratives, total_files) of a load."""
    t = triples.select("source_name", file, F.lit(1).alias("t"), F.lit(0).alias("n"))
    n = narratives.select("source_name", file, F.lit(0).alias("t"), F.lit(1).alias("n"))
    per_file = t.unionByName(n).groupBy("source_name", file).agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    return per_file.groupBy("source_name").agg(F.sum("t").alias("total_triples"), F.sum("n").alias("total_narratives"), F.count(file).alias("total_files"))
