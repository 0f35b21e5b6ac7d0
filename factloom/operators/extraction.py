"""Texts to chunks, sentences and facts: one row becomes many, inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import dims
from factloom.functions import text


def sentence_rows(docs: DataFrame, key: str, column: str, least: int = 8, marks: str = ".!?") -> DataFrame:
    """(key, sentence_no from 0, sentence)."""
    return docs.select(key, F.posexplode(text.sentences(F.col(column), least, marks)).alias("sentence_no", "sentence"))


def packed_chunks(c: Column, marks: str = "。！？；;", least: int = dims.CHUNK_LEAST, most: int = dims.CHUNK_MOST) -> Column:
    """array<string> of greedily packed sentences up to ``most`` characters.

    A buffer under ``least`` is dropped when the next sentence overflows it; a short tail joins the piece
    before it. Texts under ``least`` give none, texts up to ``most`` themselves.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"(?<=[{marks}])"), lambda s: F.trim(s)), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.concat(acc["open"], s)
        flushed = F.when(F.length(acc["open"]) >= least, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.when(F.length(joined) <= most, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(flushed.alias("done"), s.alias("open")))

    def finish(acc: Column) -> Column:
        n = F.size(acc["done"])
        merged = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["done"], -1), acc["open"])))
        tail = F.when(acc["open"] == "", acc["done"]).when((F.length(acc["open"]) < least) & (n > 0), merged).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return tail

    whole = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(whole) < least, F.array().cast("array<string>")).when(F.length(whole) <= most, F.array(whole)).otherwise(F.aggregate(parts, start, step, finish))


def rule_triples(docs: DataFrame, subject: str, column: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(subject, relation, object, raw, pattern, ordinal) by regex rules (relation, pattern with one group), all matches, in one scan."""
    found = [F.transform(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(p), 1), _numbered(f"rule_{i}", r)) for i, (r, p) in enumerate(rules)]
    rows = docs.select(F.col(subject).alias("subject"), F.explode(F.flatten(F.array(*found))).alias("_m"))
    return rows.select("subject", "_m.relation", F.col("_m.at").alias("pos"), "_m.object", "_m.pattern", F.col("_m.at").cast("long").alias("ordinal")).where(F.trim("object") != "")


def _numbered(name: str, relation: str) -> Callable[[Column, Column], Column]:
    return lambda m, at: F.struct(F.lit(name).alias("pattern"), F.lit(relation).alias("relation"), m.alias("object"), at.alias("at"))


def first_hit_facts(docs: DataFrame, subject: str, column: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Of each rule's matches in a text the first."""
    found = [F.struct(F.lit(r).alias("relation"), F.nullif(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), p, 1), F.lit("")).alias("object")) for r, p in rules]
    return docs.select(F.col(subject).alias("subject"), F.explode(F.array(*found)).alias("f")).select("subject", "f.relation", "f.object").where("object is not null")


_SIGNED = r"[+-]?\d[\d,]*(?:\.\d+)?(?:[×x]10\^?[+-]?\d+)?"
_CHOICE = lambda words: "(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + ")"


def entities(sentence: Column, tokens: Column, known: Sequence[str] = dims.BODIES, stop: Sequence[str] = dims.QUESTION_STOP) -> Column:
    """array<struct<name, type, source>> of a sentence: names among its tokens, numbers with units, ranges of heat, and parameters that it names.

    A token is a name if it is known, or has 2 to 20 signs, a letter among them and no mark, and is no function word.
    """
    s = F.coalesce(sentence, F.lit(""))
    name = lambda t: t.isin(*known) | (F.length(t).between(2, 20) & F.rlike(t, F.lit(r"\p{L}")) & ~F.rlike(t, F.lit("[。，；：、？！·～…—\n\t]")) & ~t.isin(*stop))
    made = lambda found, kind, source: F.transform(found, lambda x: F.struct(x.alias("name"), F.lit(kind).alias("type"), F.lit(source).alias("source")))
    plain = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.trim(t))
    values = F.transform(F.regexp_extract_all(s, F.lit(_SIGNED + r"\s*" + _CHOICE(dims.PARAMETER_UNITS)), F.lit(0)), lambda m: F.regexp_replace(m, r"\s", ""))
    ranges = F.regexp_extract_all(s, F.lit(_SIGNED + r"\s*" + _CHOICE(dims.RANGE_WORDS) + r"\s*" + _SIGNED + r"\s*" + _CHOICE(dims.HEAT_UNITS)), F.lit(0))
    named = F.filter(F.array(*map(F.lit, dims.PARAMETERS)), lambda p: F.contains(s, p))
    return F.concat(made(F.filter(plain, name), "entity", "tokens"), made(values, "value", "pattern"), made(ranges, "value_range", "pattern"), made(named, "parameter", "dictionary"))


def key_values(sentence: Column) -> Column:
    """array<struct<parameter, value, raw>>: the first number (with its unit) that a sentence gives for each parameter, in their order.

    A longer parameter's name hides the shorter within it.
    """
    pattern = "(" + _CHOICE(dims.PARAMETERS) + r")\s*[为是:：]?\s*(" + _SIGNED + r")\s*(" + _CHOICE(dims.PARAMETER_UNITS) + ")?"
    part = lambda m, i: F.regexp_extract(m, pattern, i)
    all_of = F.transform(F.regexp_extract_all(F.coalesce(sentence, F.lit("")), F.lit(pattern), F.lit(0)), lambda m: F.struct(part(m, 1).alias("parameter"), F.concat(part(m, 2), part(m, 3)).alias("value"), m.alias("raw")))
    names = lambda rows: F.transform(rows, lambda r: r["parameter"])
    return F.element_at(F.transform(F.array(all_of), lambda rows: F.filter(rows, lambda r, i: F.array_position(names(rows), r["parameter"]) == i + 1)), 1)


def mixture(sentence: Column) -> Column:
    """map of parts and percentages where a sentence gives two or more (of a repeated part the last); null otherwise."""
    found = F.regexp_extract_all(F.coalesce(sentence, F.lit("")), F.lit(r"([\p{L}_][\p{L}\p{N}_]*?)\s*占?\s*([\d.]+)\s*%"), F.lit(0))
    part = lambda m, i: F.regexp_extract(m, r"^([\p{L}_][\p{L}\p{N}_]*?)\s*占?\s*([\d.]+)\s*%$", i)
    pairs = F.transform(found, lambda m: F.struct(part(m, 1).alias("k"), F.concat(part(m, 2), F.lit("%")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.when(F.size(found) >= 2, F.map_from_entries(last))


def components(c: Column) -> Column:
    """Parts of a composition: split at separators, percentages and blanks dropped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;、，；]|\s(?:and|和|与)\s"), lambda p: F.trim(F.regexp_replace(p, r"[\d.]+\s*[%％]", "")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def fact_rows(pairs: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    """From (key, pos, field, value) rows of fact tables: for each relation the first row whose field has its name."""
    out = None
    for relation, name in names:
        one = pairs.where(F.contains(F.lower("field"), F.lit(name))).groupBy("key").agg(F.min_by("value", "pos").alias("value")).withColumn("relation", F.lit(relation))
        out = one if out is None else out.unionByName(one)
    return out
