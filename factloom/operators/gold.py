"""Answers judged by gold questions: expectations in one shape, the first matching rank, and why a question failed.

questions: query_id, expected (array of structs; null or empty: nothing may be found), normalized_value, expected_path and allowed (arrays), allow_inferred,
sources (array: the filter). results: query_id, rank from 1, path, and a record's fields. A question's results are few (top k), so
they are compared row by row with its expectations and only flags are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators.evaluation import failure

META = ("source", "source_name", "source_role", "origin", "source_title", "schema_version")
QUANTITIES = ("HAS_MASS", "HAS_RADIUS")


def normalized(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Records in one shape: fields and metadata trimmed, '' for null or a missing column; source_name falls back to source."""
    part = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")
    name = text.filled(part("source_name"), part("source"))
    return df.select(*keep, *(part(c).alias(c) for c in fields), *((name if c == "source_name" else part(c)).alias(c) for c in META))


def shaped(questions: DataFrame) -> DataFrame:
    """Questions whose lists are lists: paths trimmed and not blank, allowed paths default to the expected ones, expected is an array, ``empty`` where nothing is expected."""
    paths = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    allowed = paths("allowed") if "allowed" in questions.columns else F.array().cast("array<string>")
    expected = F.coalesce(F.col("expected"), F.array().cast(questions.schema["expected"].dataType))
    inferred = F.coalesce(F.col("allow_inferred"), F.lit(False)) if "allow_inferred" in questions.columns else F.lit(False)
    return questions.withColumns({"expected": expected, "expected_path": paths("expected_path"), "allowed": F.when(F.size(allowed) > 0, allowed).otherwise(paths("expected_path")), "empty": F.size(expected) == 0, "allow_inferred": inferred})


def overridden(questions: DataFrame, overrides: DataFrame, drops: DataFrame) -> DataFrame:
    """Questions without the dropped ones, with the columns of ``overrides`` (query_id and some of theirs) in place of their own where those aren't null."""
    changed = [c for c in overrides.columns if c != "query_id"]
    met = questions.join(drops.select("query_id").distinct(), "query_id", "left_anti").join(overrides.withColumnsRenamed({c: f"_{c}" for c in changed}), "query_id", "left")
    return met.withColumns({c: F.coalesce(f"_{c}", c) for c in changed}).select(*questions.columns)


def _judged(questions: DataFrame, results: DataFrame, hit: Column, near: dict[str, Column], fields: Sequence[str]) -> DataFrame:
    """A row for each question: match_rank, path, n_results, leaked, incomplete, and ``near`` of its first result."""
    rows = normalized(results, fields, ["query_id", "rank", "path"]).join(questions, "query_id")
    leaked = (F.size(F.coalesce("sources", F.array().cast("array<string>"))) > 0) & ~F.array_contains("sources", F.col("source_name"))
    found = rows.groupBy("query_id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("match_rank"), F.min_by("path", "rank").alias("path"), F.count(F.lit(1)).alias("n_results"), F.bool_or(leaked).alias("leaked"),
        F.bool_or(text.blank(F.least(*(F.when(F.col(c) == "", F.lit("")).otherwise("x") for c in META)))).alias("incomplete"), *(F.min_by(c, "rank").alias(name) for name, c in near.items()),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    met = questions.join(found, "query_id", "left")
    return met.select(*questions.columns, "match_rank", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("n_results", F.lit(0)).alias("n_results"), *map(yes, ("leaked", "incomplete", *near)))


def _verdict(judged: DataFrame, rules: Sequence[tuple[Column, str]], inferred: bool) -> DataFrame:
    """(query_id, match_rank, path, hit, failure)."""
    wrong = [(F.col("leaked"), "source leakage"), (F.col("incomplete"), "metadata contract break")]
    wrong += [((F.col("path") == "inferred") & ~F.col("allow_inferred"), "inferred boundary break")] if inferred else []
    wrong += [
        (~F.array_contains("allowed", F.col("path")), "path routing error"), (F.col("empty") & (F.col("n_results") > 0), "source leakage"), (F.col("empty"), "pass"),
        (F.col("match_rank") == 1, "pass"), (F.col("match_rank").isNotNull(), "wrong ranking"), *rules,
    ]
    return judged.select("query_id", "match_rank", "path", (F.col("match_rank").isNotNull() & ~F.col("empty")).alias("hit"), failure(wrong, "retrieval miss").alias("failure"))


def structured(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Of fact questions (expected: subject, relation, object) the first rank that is expected, by value where normalized_value is given, and the failure."""
    q = shaped(questions)
    value = F.trim(F.coalesce(F.col("normalized_value"), F.lit("")))
    same = lambda e: F.when(value != "", text.quantity_key(F.col("object")) == text.quantity_key(value)).otherwise(F.col("object") == F.trim(e["object"]))
    hit = F.exists("expected", lambda e: (F.trim(e["subject"]) == F.col("subject")) & (F.trim(e["relation"]) == F.col("relation")) & same(e))
    has = lambda c: F.exists("expected", lambda e: F.trim(e[c]) == F.col(c))
    near = {"near_subject": has("subject") & ~has("relation"), "near_quantity": F.col("relation").isin(*QUANTITIES) & (F.col("object") != "") & ~has("object")}
    judged = _judged(q, results, F.coalesce(hit, F.lit(False)), near, ("subject", "relation", "object"))
    return _verdict(judged, [(F.col("near_subject"), "wrong relation"), (F.col("near_quantity"), "wrong quantity")], True)


def narrative(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Of text questions (expected: page_title, section_any_of) the first rank with the title and, where any are given, one of the sections, and the failure."""
    q = shaped(questions)
    section = lambda e: (F.size(F.coalesce(e["section_any_of"], F.array().cast("array<string>"))) == 0) | F.exists(e["section_any_of"], lambda s: F.trim(s) == F.col("section"))
    hit = F.exists("expected", lambda e: (F.trim(e["page_title"]) == F.col("page_title")) & section(e))
    judged = _judged(q, results, F.coalesce(hit, F.lit(False)), {}, ("page_title", "section", "content"))
    return _verdict(judged, [(F.col("n_results") > 0, "wrong narrative hit")], False)
