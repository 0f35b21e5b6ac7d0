"""Entities: canonical ids through an alias table, hosts from names, node labels, measurement kinds, question routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import dims
from factloom.functions import text


def alias_table(spark: SparkSession, entities: Sequence[tuple[str, str, list[str]]] = dims.ENTITIES) -> DataFrame:
    """(alias, canonical_id, canonical_label): one row for each lower-cased alias and id."""
    rows = {(a.lower(), qid, label) for qid, label, names in entities for a in [qid, *names]}
    return spark.createDataFrame(sorted(rows), "alias string, canonical_id string, canonical_label string")


def with_entity(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Adds canonical_id, canonical_label and parse_status of a name; the alias table joins by equality."""
    raw = F.trim(F.coalesce(F.col(column), F.lit("")))
    keyed = df.withColumn("_alias", F.lower(F.regexp_replace(raw, r"(?U)\s+", " ")))
    joined = keyed.join(aliases.select(F.col("alias").alias("_alias"), F.col("canonical_id").alias("_cid"), F.col("canonical_label").alias("_label")), "_alias", "left")
    bare = F.rlike(F.upper(raw), F.lit(r"^Q\d+$"))
    return joined.withColumns({
        "canonical_id": F.when(F.col("_cid").isNotNull(), F.col("_cid")).when(bare, F.upper(raw)).otherwise(""),
        "canonical_label": F.when(F.col("_cid").isNotNull(), F.col("_label")).when(bare, F.upper(raw)).otherwise(raw),
        "parse_status": F.when(F.col("_cid").isNotNull(), "entity_normalized").when(bare, "qid_unknown_alias").otherwise("unmapped_entity"),
    }).drop("_alias", "_cid", "_label")


def groups_equivalent(df: DataFrame, key: Sequence[str], source: str, canonical: str, order: str) -> DataFrame:
    """(key, equivalent): every source resolves to ids, and all meet the ids of the first source."""
    ids = df.groupBy(*key, source).agg(F.collect_set(F.nullif(F.col(canonical), F.lit(""))).alias("ids"), F.min(order).alias("_order"))
    base = ids.groupBy(*key).agg(F.min_by("ids", "_order").alias("base"))
    met = F.bool_and((F.size("ids") > 0) & F.arrays_overlap("ids", "base"))
    return ids.join(base, list(key)).groupBy(*key).agg(F.coalesce(met, F.lit(False)).alias("equivalent"))


def host_of(name: Column) -> Column:
    """The host planet that a satellite's name begins with, or null."""
    return text.mapped(F.substring(name, 1, 2), dims.SATELLITE_HOSTS)


def anchor(phrase: Column, names: Sequence[str] = dims.ANCHORS) -> Column:
    """The longest known name that a phrase contains (of equal lengths the first listed), or null."""
    ordered = sorted(names, key=lambda n: -len(n))
    return F.coalesce(*(F.when(F.contains(phrase, F.lit(n)), F.lit(n)) for n in ordered))


def anchored(relation: Column, phrase: Column, raw: Column) -> Column:
    """Of ORBITS, LOCATED_IN and PART_OF objects the known name within, where the text says so; others as they are."""
    cue = F.when(relation == "ORBITS", text.contains_any(raw, ("绕", "轨道", "orbit"))).when(relation.isin("LOCATED_IN", "PART_OF"), text.contains_any(raw, ("位于", "属于", "located", "part of"))).otherwise(False)
    return F.when(F.coalesce(cue, F.lit(False)), F.coalesce(anchor(phrase), phrase)).otherwise(phrase)


def label_of(obj: Column, rules: Sequence[tuple[str, str]], default: str = "Entity") -> Column:
    """The label of the first keyword that is contained."""
    out = None
    for word, label in rules:
        out = F.when(F.contains(obj, F.lit(word)), label) if out is None else out.when(F.contains(obj, F.lit(word)), label)
    return F.lit(default) if out is None else out.otherwise(default)


def measurement_kind(relation: Column, *context: Column) -> Column:
    """What a value measures, from its relation and the words around it: struct(kind, confidence, warning)."""
    t = F.lower(F.regexp_replace(F.concat_ws(" ", *context), r"(?U)\s+", " "))

    def kind(name: str, confidence: float, warning: str = "") -> Column:
        return F.struct(F.lit(name).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(warning).alias("warning"))

    def first(rules: Sequence[tuple], otherwise: Column, warning: str = "") -> Column:
        out = otherwise
        for words, name, confidence in reversed(rules):
            out = F.when(text.contains_any(t, words), kind(name, confidence, warning)).otherwise(out)
        return out

    warn = "A distance from the Sun is an orbital distance, not a statement of what is orbited."
    return (
        F.when(relation == "HAS_RADIUS", first(dims.RADIUS_KINDS, kind("unknown", 0.2)))
        .when(relation == "HAS_MASS", first(dims.MASS_KINDS, kind("mass", 0.75)))
        .when(relation == "ORBITS", first(dims.ORBIT_KINDS, kind("orbit_target", 0.75), warn))
        .otherwise(first(dims.OTHER_KINDS, kind("unknown", 0.1)))
    )


def stated_kind(context: Column) -> Column:
    """What an audit takes a record to measure, from all its words; ``unspecified`` without any of the known ones."""
    low, out = F.lower(F.coalesce(context, F.lit(""))), F.lit("unspecified")
    for words, kind in reversed(dims.AUDIT_KINDS):
        out = F.when(text.contains_any(low, words), kind).otherwise(out)
    return out


def plain(question: Column) -> Column:
    """Underscores as blanks, one blank at a time, none around."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(question, F.lit("")), F.lit("_"), F.lit(" ")), r"(?U)\s+", " "))


def segments(question: Column, stop: Sequence[str] = ()) -> Column:
    """Runs of Latin words (digits may follow) and of Han characters, in their order; without stop words and single Han characters."""
    found = F.regexp_extract_all(plain(question), F.lit(r"([A-Za-z]+(?: [A-Za-z0-9]+)*|[\x{4e00}-\x{9fff}]+)"))
    return F.filter(found, lambda t: ~t.isin(*stop, "") & ((F.length(t) > 1) | F.rlike(t, F.lit("[A-Za-z0-9]"))))


def topic_terms(terms: Column, entities: Column, most: int = 8) -> Column:
    """The first ``most`` different segments that name none of the entities, compared without signs and linking words."""
    # The names are bound once a row; written into the filter they would be made again for every term.
    other = lambda names: F.filter(terms, lambda t: ~F.coalesce(F.array_contains(names, text.compact(t)), F.lit(False)))
    kept = F.element_at(F.transform(F.array(F.transform(entities, text.compact)), other), 1)
    return F.slice(F.array_distinct(kept), 1, most)


def route(question: Column) -> Column:
    """struct(intent, sources): the first family of keywords that a question has decides."""
    low = F.lower(F.coalesce(question, F.lit("")))
    mission, numeric, structured, narrative = (text.contains_any(low, w) for w in (dims.MISSION_WORDS, dims.NUMERIC_WORDS, dims.STRUCTURED_WORDS, dims.NARRATIVE_WORDS))
    intent = (
        F.when(mission, "esa_mission")
        .when(numeric & narrative, "mixed_numeric_narrative")
        .when(structured, "structured_fact")
        .when(numeric, "numeric_fact")
        .when(narrative, "narrative_explanation")
        .otherwise("uncertain")
    )
    orders = F.create_map(*(x for k, v in dims.AUTHORITY_BY_INTENT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.struct(intent.alias("intent"), F.try_element_at(orders, intent).alias("sources"))


def topic_intents(question: Column, entities: Column) -> Column:
    """What a question implies: why the Sun shines, that something does not exist, a diameter."""
    sun = F.contains(question, F.lit(dims.SUN)) | F.array_contains(entities, dims.SUN)
    asked = [
        (sun & text.contains_any(question, dims.LUMINOSITY_WORDS), "solar_luminosity"),
        (text.contains_any(question, dims.ABSENCE_WORDS), "negative_absence"),
        (text.contains_any(question, dims.DIAMETER_WORDS), "diameter"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in asked)))


def relation_hints(question: Column) -> Column:
    """Relations that a question asks for, each once, in the order of the rules."""
    low = F.lower(F.coalesce(question, F.lit("")))
    hint = {relation: text.contains_any(low, words) for relation, words in dims.HINT_WORDS.items()}
    within = F.rlike(low, F.lit("在.+中|位于.+内")) & ~F.contains(low, F.lit(dims.IN_DATA))
    size = text.contains_any(low, dims.SIZE_WORDS)
    rules = [
        (hint["ORBITS"], "ORBITS"), (F.contains(low, F.lit("发现")) & text.contains_any(low, dims.BY_WHOM) | hint["DISCOVERED_BY"], "DISCOVERED_BY"), (hint["HAS_ATMOSPHERE"], "HAS_ATMOSPHERE"),
        (hint["LOCATED_IN"] | within, "LOCATED_IN"), (hint["PART_OF"], "PART_OF"), (hint["HAS_RADIUS"] | text.contains_any(low, dims.DIAMETER_WORDS), "HAS_RADIUS"), (hint["HAS_MASS"], "HAS_MASS"),
        (size, "HAS_RADIUS"), (size, "HAS_MASS"), (hint["IS_A"], "IS_A"),
    ]
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in rules))))


def preview(question: Column) -> Column:
    """struct(intent, preferred): what the preview router would do; it changes no answer."""
    low = F.lower(F.coalesce(question, F.lit("")))
    number = text.contains_any(low, dims.PREVIEW_NUMBERS) | F.rlike(low, F.lit(r"\p{Nd}"))
    intent = F.when(number, "structured_numerical_fact").when(text.contains_any(low, dims.PREVIEW_IDENTIFIERS), "identifier_or_ontology_fact").otherwise("narrative_explanation")
    orders = F.create_map(*(x for k, v in dims.PREVIEW_SOURCES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.struct(intent.alias("intent"), orders[intent].alias("preferred"))


def strict_relation(hints: Column, primary: Column) -> Column:
    """Whether a question about one entity asks for exactly one relation that graphs hold."""
    asked = F.filter(hints, lambda h: h != "")
    return ~text.blank(primary) & (F.size(asked) == 1) & F.coalesce(F.try_element_at(asked, F.lit(1)).isin(*dims.STRICT_RELATIONS), F.lit(False))


def asks_for_host(question: Column, hints: Column, relation: str) -> Column:
    """Whether a question asks for a relation of the body that its entity orbits, not of the entity."""
    q = F.coalesce(question, F.lit(""))
    moving = text.contains_any(q, ("绕行", "公转"))
    body = F.contains(q, F.lit("行星")) | (F.contains(q, F.lit("天体")) if relation in ("IS_A", "HAS_ATMOSPHERE") else F.lit(False))
    return F.array_contains(hints, "ORBITS") & F.array_contains(hints, relation) & (text.contains_any(q, dims.HOST_MARKERS) | moving & body)
