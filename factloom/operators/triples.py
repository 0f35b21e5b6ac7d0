"""Fact tables: normalising, validating, deduplicating and choosing the best of a group.

Wherever the first of several rows wins, an explicit ordinal says which is first. Choices are aggregates
(min_by / max_by), which combine before the shuffle, so a hot group is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import dims
from factloom.functions import quantity, text, validity

SPO = ("subject", "relation", "object")


def normalize_triples(df: DataFrame, source_name: str, source_role: str = "", active: bool = True) -> DataFrame:
    """Trimmed fields with provenance defaults; what an old record calls its source becomes its title."""
    have = set(df.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    version = f"{source_name}_v1" if active else f"{source_name}_shadow_ready_v1"
    legacy = F.when(text.blank(col("source_title")) & (F.coalesce(F.trim(col("source")), F.lit("")) != source_name), F.trim(col("source")))
    out = {c: F.coalesce(F.trim(col(c)), F.lit("")) for c in (*SPO, "pattern", "raw")}
    out |= {
        "source_title": text.filled(col("source_title"), F.coalesce(F.nullif(legacy, F.lit("")), F.trim(col("subject")), F.lit(""))),
        "source": F.lit(source_name),
        "source_name": text.filled(col("source_name"), source_name),
        "source_role": text.filled(col("source_role"), source_role),
        "origin": text.origin(col("origin")),
        "type": text.filled(col("type"), "triple"),
        "schema_version": text.filled(col("schema_version"), version),
    }
    return df.withColumns(out)


def normalize_narratives(df: DataFrame, source_name: str, source_role: str = "") -> DataFrame:
    """As normalize_triples for chunks; keywords may be an array or one comma-separated string."""
    keywords = F.col("keywords") if dict(df.dtypes).get("keywords", "").startswith("array") else F.split(F.coalesce(F.col("keywords"), F.lit("")), "[,，]")
    words = F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: k != "")
    out = {c: F.coalesce(F.trim(F.col(c)), F.lit("")) for c in ("page_title", "section", "content")}
    out |= {"keywords": words, "source_name": F.lit(source_name), "source_role": F.lit(source_role), "type": F.lit("narrative"), "source_title": F.coalesce(F.trim(F.col("page_title")), F.lit(""))}
    return df.withColumns(out)


def missing_fields(df: DataFrame, fields: Sequence[str] = dims.REQUIRED_FIELDS) -> DataFrame:
    """Adds missing_fields (those required that are blank) and complete."""
    gaps = F.array_compact(F.array(*(F.when(text.blank(F.col(f).cast("string")) if f in df.columns else F.lit(True), F.lit(f)) for f in fields)))
    return df.withColumn("missing_fields", gaps).withColumn("complete", F.size("missing_fields") == 0)


def backfill(df: DataFrame, defaults: dict[str, Column | str]) -> DataFrame:
    """Fills blank fields only; changed says whether any was."""
    changed, new = F.lit(False), {}
    for name, value in defaults.items():
        new[name] = text.filled(F.col(name), value)
        changed = changed | ~new[name].eqNullSafe(F.col(name))
    return df.withColumn("changed", changed).withColumns(new)


def plausible_subject(c: Column) -> Column:
    """A name of 2 to 40 characters that starts with no linking word and holds no sentence punctuation."""
    starts = F.lit(False)
    for p in dims.NOISY_PREFIXES:
        starts = starts | F.startswith(c, F.lit(p))
    return F.length(c).between(2, 40) & ~starts & ~F.rlike(c, F.lit(r"[。！？!?；;]"))


def with_faults(df: DataFrame, relations: Sequence[str] = dims.GRAPH_RELATIONS) -> DataFrame:
    """The rows with why a load rejects them (``fault``): relation, subject, object or the words around a quantity; null if it doesn't."""
    checked = validity.with_fault(df.withColumn("_subject_fault", validity.subject_fault(F.trim("subject"))), "_object_fault")
    sense = quantity.semantics_allow(F.col("relation"), F.concat_ws(" ", "raw", "pattern"))
    fault = (
        F.when(F.coalesce(~F.col("relation").isin(*relations), F.lit(True)), "relation")
        .when(F.col("_subject_fault").isNotNull(), F.concat(F.lit("subject "), F.col("_subject_fault")))
        .when(F.col("_object_fault").isNotNull(), F.concat(F.lit("object "), F.col("_object_fault")))
        .when(~sense, "context")
    )
    return checked.withColumn("fault", fault).drop("_subject_fault", "_object_fault")


def clean_triples(df: DataFrame, relations: Sequence[str] = dims.GRAPH_RELATIONS, strict: bool = False) -> DataFrame:
    """Rows of known relations with a plausible subject and an object that suits the relation.

    Quantities need words around them that allow their reading and a positive number, other objects up to
    60 characters; objects are normalised on the way. If strict, only rows without a fault (``with_faults``) stay.
    """
    if strict:
        df = with_faults(df, relations).where("fault is null").drop("fault")
    obj = text.object_text(F.col("object"))
    sense = quantity.semantics_allow(F.col("relation"), F.concat_ws(" ", "raw", "pattern"))
    number = text.first_number(text.scientific_text(F.col("object")))
    ok = F.when(F.col("relation").isin(*dims.QUANTITY_RELATIONS), sense & (F.coalesce(number, F.lit(0.0)) > 0)).otherwise((obj != "") & (F.length(obj) <= 60))
    kept = df.where(F.col("relation").isin(*relations) & plausible_subject(F.trim("subject")) & ok)
    return kept.withColumns({"subject": F.trim("subject"), "object": F.when(F.col("relation").isin(*dims.QUANTITY_RELATIONS), F.trim("object")).otherwise(obj)})


def first_of(df: DataFrame, keys: Sequence[str], order: str = "ordinal", last: bool = False) -> DataFrame:
    """The row of each key with the least (or greatest) ordinal; columns as before."""
    pick = F.max_by if last else F.min_by
    row = F.struct(*df.columns)
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(pick(row, F.col(order)).alias("_row")).select("_row.*")


def first_by_prefix(df: DataFrame, column: str, length: int = 100, order: str = "ordinal") -> DataFrame:
    """One row for each first ``length`` characters."""
    keyed = df.withColumn("_prefix", F.substring(column, 1, length))
    return first_of(keyed, ["_prefix"], order).drop("_prefix")


def best_of(df: DataFrame, keys: Sequence[str], score: Column, order: str = "ordinal") -> DataFrame:
    """The row of each key with the greatest score, of equals that with the least ordinal; adds score."""
    scored = df.withColumn("score", score)
    rank = F.struct(F.col("score"), -F.col(order))
    return scored.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(F.struct(*scored.columns), rank).alias("_row")).select("_row.*")


def best_triples(df: DataFrame) -> DataFrame:
    """Of quantities the best candidate of each (subject, relation), of others that of each triple."""
    is_quantity = F.col("relation").isin(*dims.QUANTITY_RELATIONS)
    q = quantity.quantity_score(F.col("relation"), F.col("raw"), F.col("object"), F.col("pattern"))
    keyed = df.withColumn("_object", F.when(~is_quantity, F.col("object")))
    score = F.when(is_quantity, q).otherwise(quantity.relation_score(F.col("pattern"), F.col("raw"))).cast("int")
    return best_of(keyed, ["subject", "relation", "_object"], score).where("score >= 0").drop("_object")


def first_answering(resolvers: Sequence[DataFrame]) -> DataFrame:
    """For each probe the rows of the first resolver that has any; resolvers share columns with ``probe``."""
    union = None
    for i, r in enumerate(resolvers):
        one = r.withColumn("priority", F.lit(i))
        union = one if union is None else union.unionByName(one)
    best = union.groupBy("probe").agg(F.min("priority").alias("priority"))
    return union.join(best, ["probe", "priority"])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """MERGE: rows of both by key; new values win but for the columns of ``keep_old``, whose non-null old ones stay."""
    others = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep_old else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    action = F.when(F.col(f"o.{keys[0]}").isNull(), "created").when(F.col(f"n.{keys[0]}").isNull(), "kept").otherwise("matched")
    return o.join(n, on, "full_outer").select(*(F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys), *(pick(c).alias(c) for c in others), action.alias("merge_action"))


def canonical_merge(df: DataFrame, keys: Sequence[str], score: Column, order: str, fill: Sequence[str]) -> DataFrame:
    """The best row of each key, its blank ``fill`` columns taken from the key's first row that has them."""
    best = best_of(df, keys, score, order)
    filled = df.groupBy(*keys).agg(*(F.min_by(c, F.when(~text.blank(F.col(c)), F.col(order))).alias(f"_{c}") for c in fill))
    return best.join(filled, list(keys)).withColumns({c: text.filled(F.col(c), F.col(f"_{c}")) for c in fill}).select(*best.columns)
