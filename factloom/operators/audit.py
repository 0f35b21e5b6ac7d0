"""Audits of facts across sources: statuses by key in three generations, missing sources, evidence packets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import dims
from factloom.functions import entity, quantity, text
from factloom.operators.quality import numbered
from factloom.operators.triples import missing_fields
from factloom.sources.tables import cut

KEY = ("subject", "relation")


def by_source(records: DataFrame, value: Column | None = None, number: str | None = None) -> DataFrame:
    """One row for each key and source: first value, extremes of the numbers, a digest of the set of objects, and
    whether a normalised value is also one of the key's first source.

    Sets of values are never collected: a digest (count, xor and sum of hashes of the distinct objects) compares
    them, and a semi-join finds common values, so a key with very many values is no single row.

    ``value`` is a record's value, by default its object's; if it needs nothing of the record but its object, relation and the double
    ``number``, naming that column lets the records be grouped by a hash table of numbers, without sorting them.
    """
    own = [*KEY, "source_name"]
    # One pass over the records: the distinct objects of a key and source, written once; all else comes from these.
    if value is None or number is not None:
        numbers = [] if number is None else [F.min_by(number, "ordinal").alias(number), F.min(number).alias("low"), F.max(number).alias("high")]
        distinct = records.groupBy(*own, "object").agg(F.min("ordinal").alias("ordinal"), *numbers)
        distinct = quantity.with_value(distinct, F.col("object"), F.col("relation"), "value") if value is None else distinct.withColumn("value", value)
        ends = (F.col("value.numeric_value"), F.col("value.numeric_value")) if number is None else (F.col("low"), F.col("high"))
        distinct = cut(distinct.select(*own, "object", F.col("value.normalized_value").alias("normal"), "value", ends[0].alias("low"), ends[1].alias("high"), "ordinal"))
    else:
        v = lambda part: F.col(f"_value.{part}")
        distinct = cut(records.withColumn("_value", value).groupBy(*own, "object").agg(F.min(v("normalized_value")).alias("normal"), F.min_by("_value", "ordinal").alias("value"), F.min(v("numeric_value")).alias("low"), F.max(v("numeric_value")).alias("high"), F.min("ordinal").alias("ordinal")))
    digest = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("object")).alias("x"), F.sum(F.xxhash64(F.lit(7), "object").cast("decimal(38,0)")).alias("s"))
    per = cut(distinct.groupBy(*own).agg(F.min_by("value", "ordinal").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("ordinal").alias("first_ordinal"), digest.alias("objects")))
    heads = per.groupBy(*KEY).agg(F.min_by("source_name", "first_ordinal").alias("source_name"))
    theirs = distinct.join(heads, own, "left_semi").select(*KEY, "normal")
    shared = distinct.join(theirs, [*KEY, "normal"], "left_semi").select(*own).distinct().withColumn("shares", F.lit(True))
    return per.join(shared, own, "left").withColumn("shares", F.coalesce("shares", F.lit(False)))


def _keys(per_source: DataFrame) -> DataFrame:
    """Aggregates over the few sources of a key."""
    base = per_source.groupBy(*KEY).agg(
        F.min_by(F.struct("first", "objects"), "first_ordinal").alias("base"),
        F.count("*").alias("n_sources"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    met = per_source.select(*KEY, "first", "objects", "shares").join(base, list(KEY))
    return met.groupBy(*KEY).agg(
        F.max("n_sources").alias("n_sources"),
        F.bool_and(F.col("objects") == F.col("base.objects")).alias("exact"),
        F.bool_and(quantity.equivalent(F.col("base.first"), F.col("first")) & F.col("first.numeric_value").isNotNull()).alias("unit_equal"),
        F.bool_and("shares").alias("overlap"),
        F.max("low").alias("low"),
        F.max("high").alias("high"),
    )


def status_v1(per_source: DataFrame) -> DataFrame:
    """exact_match, unit_equivalent (0.2 %), value_conflict of each key with two sources or more."""
    k = _keys(per_source).where("n_sources >= 2")
    return k.select(*KEY, "n_sources", F.when(F.col("exact"), "exact_match").when(F.col("unit_equal"), "unit_equivalent").otherwise("value_conflict").alias("status"))


def status_v2(per_source: DataFrame, wild: float = 5.0) -> DataFrame:
    """As v1, then overlapping normalised values, then numbers so far apart that an extraction error is likelier."""
    k = _keys(per_source).where("n_sources >= 2")
    ratio = F.coalesce(F.col("high") / F.col("low"), F.lit(1.0))
    status = F.when(F.col("exact"), "exact_match").when(F.col("unit_equal"), "unit_equivalent").when(F.col("overlap"), "normalized_equivalent").when((F.col("low") > 0) & (ratio >= wild), "source_extraction_error").otherwise("value_conflict")
    return k.select(*KEY, "n_sources", status.alias("status"))


def status_v3(per_source: DataFrame, spread: float = dims.KIND_SPREAD, wild: float = 5.0) -> DataFrame:
    """As v2, with a spread of up to 8 % read as a difference of measurement kinds; adds rel_spread."""
    k = _keys(per_source).where("n_sources >= 2")
    gap = quantity.relative_difference(F.col("low"), F.col("high"))
    ratio = F.coalesce(F.col("high") / F.col("low"), F.lit(1.0))
    status = (
        F.when(F.col("exact"), "exact_match").when(F.col("unit_equal"), "unit_equivalent").when(F.col("overlap"), "normalized_equivalent")
        .when((F.col("low") > 0) & (ratio >= wild), "source_extraction_error").when(gap <= spread, "measurement_kind_difference").otherwise("value_conflict")
    )
    return k.select(*KEY, "n_sources", gap.alias("rel_spread"), status.alias("status"))


def _token(tag: str, token: Column, place: Column | None = None) -> Column:
    """What a value meets others by: equal tokens of a tag, and for numbers neighbouring bins."""
    return F.struct(F.lit(tag).alias("tag"), token.alias("token"), (F.lit(0) if place is None else place).cast("bigint").alias("bin"))


def _number_tokens(unit: Column, x: Column, tolerance: float) -> Column:
    """Close numbers of a unit lie in one logarithmic bin or in neighbours, tiny ones in bins of the absolute tolerance, so an equi-join finds them."""
    kind = lambda k: F.concat_ws(" ", k.cast("string"), unit)
    at = F.floor(F.log(F.abs(x)) / -math.log1p(-tolerance))
    return F.array(F.when(unit.isNotNull() & (x != 0), _token("numeric", kind(F.signum(x).cast("int")), at)), F.when(unit.isNotNull() & (F.abs(x) <= 1e-9 / tolerance), _token("numeric", kind(F.lit(2)), F.floor(x / 1e-9))))


def _meet(tokens: DataFrame, heads: DataFrame, own: Sequence[str], tolerance: float) -> DataFrame:
    """(own, tag) of the keys' sources that share a token, or a close number, with the key's first source; all tags in one join."""
    near = F.explode(F.when(F.col("tag") == "numeric", F.array(*(F.col("bin") + i for i in (-1, 0, 1)))).otherwise(F.array("bin")))
    base = tokens.join(heads, list(own), "left_semi").select(*KEY, "tag", "token", F.when(F.col("tag") == "numeric", F.col("number")).alias("other"), near.alias("bin")).distinct()
    alike = (F.col("tag") != "numeric") | quantity.close(F.col("number"), F.col("other"), tolerance)
    return tokens.join(base, [*KEY, "tag", "token", "bin"]).where(alike).select(*own, "tag").distinct()


def _numbers_meet(numbers: DataFrame, heads: DataFrame, own: Sequence[str], tolerance: float) -> DataFrame:
    """The keys' sources with a number close to one of the key's first source."""
    tokens = numbers.select(*own, "number", F.explode(F.array_compact(_number_tokens(F.col("unit"), F.col("number"), tolerance))).alias("t")).select(*own, "number", "t.*")
    return _meet(tokens, heads, own, tolerance).select(*own)


def statuses(records: DataFrame, universe: Sequence[str] = dims.AUDIT_SOURCES, aliases: DataFrame | None = None, suspect: str = dims.SUSPECT_SOURCE, refined: bool = True, tolerance: float = dims.AUDIT_TOLERANCE, spread: float = dims.KIND_SPREAD) -> DataFrame:
    """(subject, relation, n_sources, statuses): all that an audit says of a key, in a fixed order.

    source_missing and insufficient_metadata stand beside one verdict of how two or more sources agree: exact_match,
    unit_equivalent, normalized_equivalent, synonym_equivalent (gas sets of which one holds the other); refined also
    entity_alias_equivalent (needs ``aliases``), same_quantity_different_measurement_kind with radius_kind_mismatch, and
    mass_reference_mismatch; then likely_zhwiki_extraction_error (radii of the suspect source far below the others') and value_conflict.
    Every source is held against the first present of the universe, sources outside it coming last by name. Records with a blank
    subject or relation don't count; a null object is an empty one. Values are compared by joins, and no set of values is
    collected: only a key's source names, kinds (at most six) and gas sets are.
    """
    own = [*KEY, "source_name"]
    context = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("raw", "object", "pattern", "table_field") if c in records.columns))
    rows = records.withColumns({"subject": F.trim("subject"), "relation": F.trim("relation"), "object": F.coalesce("object", F.lit("")), "_kind": entity.stated_kind(context)})
    rows = missing_fields(rows.where("subject != '' and relation != '' and source_name is not null"))
    rows = quantity.with_value(rows, F.col("object"), F.col("relation"), "_value")
    # The distinct objects of a key and source, written once; everything else comes from these.
    distinct = rows.groupBy(*own, "object").agg(F.first("_value").alias("value"), F.count("*").alias("n"), F.bool_or(~F.col("complete")).alias("broken"), F.collect_set("_kind").alias("kinds"))
    unit, number, normal = F.nullif(F.col("value.normalized_unit"), F.lit("")), F.col("value.numeric_value"), F.nullif(F.col("value.normalized_value"), F.lit(""))
    plain = F.lower(F.trim(F.regexp_replace("object", r"(?U)\s+", " ")))
    distinct = distinct.select(*own, "n", "broken", "kinds", plain.alias("plain"), unit.alias("unit"), number.alias("number"), normal.alias("normal"), F.col("value.parse_status").alias("parsed"), "object")
    distinct = cut(distinct)

    km, ours = F.when(F.col("unit") == "km", F.col("number")), F.col("source_name") == suspect
    place = F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, universe)), F.col("source_name")), F.lit(0)), F.lit(len(universe) + 1)).alias("place"), F.col("source_name").alias("source_name"))
    keys = distinct.groupBy(*KEY).agg(
        F.collect_set("source_name").alias("have"), F.min(place).alias("head"), F.bool_or("broken").alias("broken"),
        F.size(F.array_remove(F.array_distinct(F.flatten(F.collect_set("kinds"))), "unspecified")).alias("n_kinds"),
        F.sum(F.when(km.isNotNull(), F.col("n"))).alias("n_km"), F.min(km).alias("low"), F.max(km).alias("high"), (F.min(F.round(km, 1)) < F.max(F.round(km, 1))).alias("differ"),
        F.min(F.when(ours & (km > 0), km)).alias("our_low"), F.max(F.when(ours, km)).alias("our_high"), F.max(F.when(~ours, km)).alias("their_high"),
        ((F.min("unit") < F.max("unit")) | F.bool_or(F.col("parsed") == "unknown_unit")).alias("mixed"),
    )
    keys = cut(keys.withColumn("n_sources", F.size("have")))
    heads = keys.where("n_sources >= 2").select(*KEY, F.col("head.source_name").alias("source_name"))

    own_tokens = F.array_compact(F.concat(F.array(F.when(F.col("normal").isNotNull(), _token("normal", F.col("normal")))), _number_tokens(F.col("unit"), F.col("number"), tolerance)))
    tokens = distinct.select(*own, "number", F.explode(own_tokens).alias("t")).select(*own, "number", "t.*")
    if refined and aliases is not None:
        named = entity.with_entity(distinct.where(F.col("relation").isin(*dims.ENTITY_RELATIONS)).select(*own, "number", "object"), "object", aliases)
        tokens = tokens.unionByName(named.where("canonical_id != ''").select(*own, "number", _token("alias", F.col("canonical_id")).alias("t")).select(*own, "number", "t.*"))
    tagged = _meet(tokens, heads, own, tolerance)
    gases = distinct.where("unit = 'component_set'").groupBy(*own).agg(F.array_distinct(F.flatten(F.collect_set(F.split("normal", ";")))).alias("gases"))
    first = gases.join(heads, own, "left_semi").select(*KEY, F.col("gases").alias("first"))
    within = (F.size(F.array_except("gases", "first")) == 0) | (F.size(F.array_except("first", "gases")) == 0)
    mixes = gases.join(first, list(KEY)).groupBy(*KEY).agg(F.count_if(F.arrays_overlap("gases", "first") & within).alias("_gas"))
    counts = tagged.groupBy(*KEY).agg(*(F.count_if(F.col("tag") == tag).alias(f"_{tag}") for tag in ("numeric", "normal", "alias")))
    texts = distinct.select(*own, "plain").distinct().groupBy(*KEY, "plain").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.min("n").alias("_exact"))
    all_in = lambda tag: F.col(f"_{tag}") == F.col("n_sources")

    is_radius, is_mass = F.col("relation") == "HAS_RADIUS", F.col("relation") == "HAS_MASS"
    cut_short = ((F.col("their_high") >= 1000) & (F.col("our_low") < 100)) | ((F.col("their_high") / F.greatest("our_high", F.lit(1e-9)) >= 5) & F.col("our_high").isNotNull())
    kinds = ((F.col("high") - F.col("low")) / F.greatest("high", F.lit(1e-9)) <= spread) & ((F.col("n_kinds") >= 2) | F.col("differ")) & (F.col("n_km") >= 2)
    verdict = F.when(all_in("exact"), "exact_match").when(all_in("numeric"), "unit_equivalent").when(all_in("normal"), "normalized_equivalent").when(all_in("gas"), "synonym_equivalent")
    if refined:
        verdict = verdict.when(all_in("alias"), "entity_alias_equivalent")
    verdict = verdict.when(is_radius & cut_short, "likely_zhwiki_extraction_error")
    if refined:
        verdict = verdict.when(is_radius & kinds, "same_quantity_different_measurement_kind").when(is_mass & F.col("mixed"), "mass_reference_mismatch")
    found = keys.join(texts, list(KEY)).join(counts, list(KEY), "left").join(mixes, list(KEY), "left").withColumn("verdict", F.when(F.col("n_sources") >= 2, verdict.otherwise("value_conflict")))
    missing = F.size(F.array_except(F.array(*map(F.lit, universe)), F.col("have"))) > 0
    every = F.array(
        F.when(missing, "source_missing"), F.when(F.col("broken"), "insufficient_metadata"), F.col("verdict"),
        F.when(F.col("verdict") == "same_quantity_different_measurement_kind", "radius_kind_mismatch"),
    )
    return found.select(*KEY, "n_sources", F.array_compact(every).alias("statuses"))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n_keys"))


def missing_sources(records: DataFrame, universe: Sequence[str]) -> DataFrame:
    """(subject, relation, source_name) for each source of the universe that has nothing for a key."""
    present = records.groupBy(*KEY).agg(F.collect_set("source_name").alias("have"))
    gaps = F.array_except(F.array(*map(F.lit, universe)), F.col("have"))
    return present.select(*KEY, F.explode(gaps).alias("source_name"))


def missing_breakdown(missing: DataFrame) -> DataFrame:
    """Counts by source, by relation and by both, in one pass of grouping sets."""
    sets = [[F.col("source_name")], [F.col("relation")], [F.col("source_name"), F.col("relation")]]
    return missing.groupingSets(sets, F.col("source_name"), F.col("relation")).agg(F.count("*").alias("n_missing"))


def evidence_packets(statuses: DataFrame) -> DataFrame:
    """Remaining conflicts with a class, an action and a confidence, numbered by key within their relation."""
    left = statuses.where("status = 'value_conflict'")
    cls = F.when((F.col("relation") == "HAS_MASS") & (F.col("rel_spread") <= 0.01), "mass_granularity").when(F.col("rel_spread").isNull(), "text_difference").otherwise("true_conflict")
    action = F.when(cls == "mass_granularity", "annotate_precision").when(cls == "text_difference", "review_alias").otherwise("manual_review")
    return numbered(left, ["relation"], "subject", "packet_no").select(*KEY, cls.alias("evidence_class"), action.alias("action"), F.when(cls == "mass_granularity", 0.76).when(cls == "text_difference", 0.74).otherwise(0.6).alias("confidence"), "packet_no")


def evidence_classes(records: DataFrame, conflicts: DataFrame, aliases: DataFrame, suspect: str = dims.SUSPECT_SOURCE, spread: float = 0.01) -> DataFrame:
    """(subject, relation, evidence_class, resolution, confidence): why each conflicting key's values differ, as far as its records tell.

    Orbits: names of one entity, a system in the host's place, or true. Radii: one of the suspect source under 100 km, or several kinds
    of radius. Masses: within 1 % of each other, or a unit that isn't known. Else a true conflict. conflicts: subject, relation (and
    statuses, where radius_kind_mismatch counts as several kinds). Only a key's kinds, of which there are few, are gathered.
    """
    rows = records.join(conflicts.select(*KEY).distinct(), list(KEY), "left_semi").withColumns({"subject": F.trim("subject"), "relation": F.trim("relation"), "object": F.coalesce("object", F.lit(""))})
    kind = entity.measurement_kind(F.col("relation"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("raw", "source_title", "table_field", "pattern") if c in records.columns))
    rows = cut(quantity.with_value(rows, F.col("object"), F.col("relation"), "_value").withColumn("_kind", kind["kind"]))
    unit, number = F.col("_value.normalized_unit"), F.col("_value.numeric_value")
    kg = F.when((unit == "kg") & (number > 0), number)
    per = rows.groupBy(*KEY).agg(
        F.bool_or(F.col("object").isin(*dims.ORBIT_SYSTEMS)).alias("system"),
        F.bool_or((F.col("source_name") == suspect) & (unit == "km") & (number < 100)).alias("small"),
        F.size(F.array_remove(F.collect_set("_kind"), "unknown")).alias("n_kinds"),
        F.count(kg).alias("n_kg"), F.min(kg).alias("low"), F.max(kg).alias("high"), F.bool_or(F.col("_value.parse_status") == "unknown_unit").alias("no_unit"),
    )
    named = entity.with_entity(rows.where("relation = 'ORBITS'").select(*KEY, "source_name", "object"), "object", aliases)
    same = entity.groups_equivalent(named, KEY, "source_name", "canonical_id", "source_name")
    flags = conflicts.groupBy(*KEY).agg(F.max(F.array_contains("statuses", "radius_kind_mismatch")).alias("_kinds")) if "statuses" in conflicts.columns else conflicts.select(*KEY).distinct().withColumn("_kinds", F.lit(False))
    met = per.join(flags, list(KEY)).join(same, list(KEY), "left")
    r, yes = F.col("relation"), lambda c: F.coalesce(F.col(c), F.lit(False))
    near = (F.col("n_kg") >= 2) & ((F.col("high") - F.col("low")) / F.greatest("high", F.lit(1e-9)) <= spread)
    name = (
        F.when(r == "ORBITS", F.when(yes("equivalent"), "entity_alias_gap").when(yes("system"), "ontology_semantics_mismatch").otherwise("true_orbit_conflict"))
        .when((r == "HAS_RADIUS") & yes("small"), "zhwiki_extraction_error").when((r == "HAS_RADIUS") & ((F.col("n_kinds") >= 2) | yes("_kinds")), "measurement_kind_mismatch")
        .when((r == "HAS_MASS") & near, "source_granularity_mismatch").when((r == "HAS_MASS") & yes("no_unit"), "wikidata_unit_or_qualifier_gap").otherwise("true_value_conflict")
    )
    table = F.create_map(*(x for k, (action, sure) in dims.EVIDENCE_CLASSES.items() for x in (F.lit(k), F.struct(F.lit(action).alias("action"), F.lit(sure).alias("confidence")))))
    return met.withColumn("_name", name).withColumn("_row", table[F.col("_name")]).select(*KEY, F.when(F.col("_name") == "true_orbit_conflict", "true_value_conflict").otherwise(F.col("_name")).alias("evidence_class"), F.col("_row.action").alias("resolution"), F.col("_row.confidence").alias("confidence"))


def cross_ratio(per_source: DataFrame, factor: float = 100.0) -> DataFrame:
    """Keys whose numbers differ by the factor or more between any two sources."""
    k = per_source.groupBy(*KEY).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return k.where((F.col("low") > 0) & (F.col("high") / F.col("low") >= factor))
