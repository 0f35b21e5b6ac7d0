"""Text normalisation as column expressions; nulls become '' only where a function says so."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import dims

# Java classes with Unicode white space, digits and word characters.
_U = "(?U)"
#: A signed decimal number, with e-notation.
NUMBER = r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once a row, however often f names it; written out, it would be worked out again at each place."""
    return F.element_at(F.transform(F.array(value), f), 1)


def blank(c: Column) -> Column:
    """Whether a string is null, empty or white space."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def filled(c: Column, default: Column | str) -> Column:
    """The trimmed string, or the default where it is blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), default if isinstance(default, Column) else F.lit(default))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def to_simplified(c: Column, traditional: str = "", simplified: str = "") -> Column:
    """Characters mapped one by one; without a table the text itself. Null becomes ''."""
    return F.translate(F.coalesce(c, F.lit("")), traditional, simplified) if traditional else F.coalesce(c, F.lit(""))


def mapped(c: Column, table: Mapping[str, str], default: Column | str | None = None) -> Column:
    """The table's value for a string, or the default."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, c), default if isinstance(default, Column) else F.lit(default))


def origin(c: Column, default: str = "api") -> Column:
    return mapped(F.lower(F.trim(c)), dims.ORIGIN_ALIASES, default)


def canonical_text(c: Column) -> Column:
    """Full-width separators to ASCII, white space collapsed; null becomes ''."""
    t = F.translate(F.coalesce(c, F.lit("")), "；，", ";,")
    return F.trim(F.regexp_replace(t, _U + r"\s+", " "))


def scientific_text(c: Column) -> Column:
    """Numbers as a parser takes them: no thousands separators, mantissas in one piece, powers of ten as e-notation."""
    t = F.replace(canonical_text(c), F.lit(","), F.lit(""))
    t = F.regexp_replace(t, r"(?<=\.\d{1,30})\s+(?=\d)", "")
    # A cross and ten, with or without a caret; ten with a caret alone; a blank before the e.
    t = F.regexp_replace(t, r"(?i)\s*[×x]\s*10\s*\^?\s*(?=[+-]?\d)", "e")
    t = F.replace(t, F.lit("10^"), F.lit("1e"))
    return F.regexp_replace(t, r"(?<=\d)\s+(?=e[+-]?\d)", "")


def first_number(c: Column) -> Column:
    """The first signed decimal or e-notation number as a double, or null."""
    return F.nullif(F.regexp_extract(c, NUMBER, 0), F.lit("")).try_cast("double")


def number_text(c: Column) -> Column:
    """A double with up to 12 significant digits, no trailing zeros, e-notation from 1e12 or below 1e-4."""

    def shown(s: Column) -> Column:
        plain = F.regexp_replace(s.cast("decimal(30,16)").cast("string"), r"\.?0+$", "")
        return F.when(F.rlike(s, F.lit(r"e(-0[1-4]|\+0\d|\+1[01])$")), F.regexp_replace(plain, "^-0$", "0")).otherwise(F.regexp_replace(s, r"\.?0*e", "e"))

    return bound(F.format_string("%.11e", c), shown)


def safe_name(c: Column) -> Column:
    """A node name: trimmed, quotes escaped, full-width semicolons narrowed, 100 characters at most."""
    t = F.trim(F.coalesce(c, F.lit("")))
    t = F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.substring(F.replace(t, F.lit("；"), F.lit(";")), 1, 100)


def object_text(c: Column) -> Column:
    """White space collapsed, a closing nationality in brackets dropped, punctuation at the ends stripped."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), _U + r"\s+", " ")
    t = F.regexp_replace(t, r"[（(][^（）()]{1,8}(?:人|籍)[)）]\s*$", "")
    return F.regexp_replace(t, r"^[\s，,。；;：:、]+|[\s，,。；;：:、]+$", "")


def entity_name(c: Column) -> Column:
    """Underscores to spaces, cut at '#', spaces collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.substring_index(F.coalesce(c, F.lit("")), "#", 1), F.lit("_"), F.lit(" ")), _U + r"\s+", " "))


def file_title(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|]', "_")


def strip_markers(c: Column) -> Column:
    """Sort keys (all before the spade) dropped, power-of-ten marks and unit words unified."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[0-9.]*♠", "")
    t = F.regexp_replace(t, r"(?U)[x×X]\s*10\s*\^?\s*", "×10^")
    for word, unit in (("公里", "km"), ("千米", "km"), ("千克", "kg"), ("公斤", "kg")):
        t = F.replace(t, F.lit(word), F.lit(unit))
    return F.trim(F.regexp_replace(t, _U + r"\s+", " "))


def scalar_number(c: Column) -> Column:
    """Brackets dropped, digit groups joined, the first number token kept."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[（(][^（）()]*[)）]", "")
    t = F.regexp_replace(t, r"(?<=\d)[,\s](?=\d)", "")
    return F.regexp_extract(t, r"([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1)


def unit_name(c: Column) -> Column:
    table = {"kilometer": "km", "kilometers": "km", "kilometre": "km", "kilometres": "km", "公里": "km", "千米": "km", "kgs": "kg", "kilogram": "kg", "kilograms": "kg", "千克": "kg", "公斤": "kg"}
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return mapped(low, table, low)


def quantity_key(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("×"), F.lit("x")), _U + r"[\s,，]", "")


def excerpt(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def compact(c: Column) -> Column:
    """Han, Latin letters and digits only, lower-cased, without linking words."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"的|之", ""), r"[^\p{IsHan}a-z0-9]", "")


def percent_claims(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:\.\d+)?\s*[%％])"))))


def fact_sentence(subject: Column, relation: Column, obj: Column, templates: Mapping[str, str]) -> Column:
    """A relation's template with {s} and {o} filled in; the bare triple without a template."""
    pattern = mapped(relation, templates, F.concat(F.lit("{s} "), relation, F.lit(" {o}")))
    return F.replace(F.replace(pattern, F.lit("{s}"), F.coalesce(subject, F.lit(""))), F.lit("{o}"), F.coalesce(obj, F.lit("")))


def short_id(*parts: Column) -> Column:
    """12 hex digits of the md5 of the parts joined by '|'; null parts count as ''."""
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, 12)


def redact(c: Column) -> Column:
    return F.regexp_replace(c, r"sk-[A-Za-z0-9_-]{8,}", "sk-***")


def has_secret(c: Column) -> Column:
    """Whether a text holds a key as ``redact`` takes it out; false for null."""
    return F.coalesce(F.rlike(c, F.lit(r"sk-[A-Za-z0-9_-]{8,}")), F.lit(False))


def display_value(value: Column, unit: Column) -> Column:
    """The value with its unit, unless the unit is blank or already in it."""
    return F.when(blank(unit) | F.contains(value, unit), value).otherwise(F.concat_ws(" ", value, unit))


def context_text(raw: Column, field: Column, hint: Column, obj: Column) -> Column:
    """The raw text, or where it is blank the field, relation hint and object joined."""
    return F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.concat_ws(" ", field, hint, obj))


def utc_timestamp(c: Column) -> Column:
    """ISO-8601 to a timestamp; null where it doesn't parse. A time without a zone counts as UTC, whatever the session's zone; a date as its midnight."""
    t = F.trim(c)
    whole = F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(t, F.lit("T00:00:00"))).otherwise(t)
    return F.try_to_timestamp(F.when(F.rlike(whole, F.lit(r"(?:[Zz]|[+-]\d{2}(?::?\d{2})?)$")) & F.rlike(whole, F.lit(":")), whole).otherwise(F.concat(whole, F.lit("Z"))))


def answer_text(c: Column, most: int = 6) -> Column:
    """Reasoning blocks and role markers removed, the first sentences kept."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", "")
    t = F.trim(F.regexp_replace(t, r"<\|[^|>]*\|>", ""))
    return F.array_join(F.slice(F.filter(F.split(t, r"(?<=[。！？!?.])\s*"), lambda s: s != ""), 1, most), " ")


def sentences(c: Column, least: int = 8, marks: str = "。！？；;") -> Column:
    """Sentences that end at one of the marks, trimmed, of at least ``least`` characters."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), f"(?<=[{marks}])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least)
