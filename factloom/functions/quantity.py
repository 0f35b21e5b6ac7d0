"""Values of relations: masses and radii with units, gas sets, equivalence, and quantities derived from others."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import dims
from factloom.functions import text

VALUE = "struct<normalized_value:string,normalized_unit:string,numeric_value:double,confidence:double,parse_status:string,unit_id:string>"


def _value(value: Column, unit: str | Column, number: Column | None, confidence: float | Column, status: str | Column, unit_id: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        value.alias("normalized_value"),
        lit(unit).alias("normalized_unit"),
        (F.lit(None).cast("double") if number is None else number).alias("numeric_value"),
        lit(confidence).cast("double").alias("confidence"),
        lit(status).alias("parse_status"),
        (F.lit(None).cast("string") if unit_id is None else unit_id).alias("unit_id"),
    )


#: How sure a reading is, by how it ended.
CONFIDENCE = {"parsed": 0.95, "unparsed": 0.2, "unit_dimension_mismatch": 0.1, "unknown_unit": 0.0}


def _with_id(sci: Column) -> Column:
    """A number and the unit id after it, or ''."""
    return F.regexp_extract(sci, text.NUMBER + r"\s+[Qq]\d+", 0)


def _unit_id(with_id: Column) -> Column:
    return F.upper(F.regexp_extract(with_id, r"[Qq]\d+$", 0))


def _mass_factor(low: Column) -> Column:
    """Kilograms in the unit that a text names; null without one."""
    out = None
    for names, kg in dims.MASS_NAMES:
        there = text.contains_any(low, names)
        out = F.when(there, kg) if out is None else out.when(there, kg)
    return out


def _words(low: Column) -> Column:
    return F.split(low, r"[^\p{L}\p{N}_]+")


def _length_factor(low: Column, words: Column) -> Column:
    """Kilometres in the unit that a text names; null without one."""
    has = lambda names, signs: F.arrays_overlap(words, F.array(*map(F.lit, names))) | text.contains_any(low, signs)
    metres = has(dims.METRE_WORDS, dims.METRE_SIGNS) & ~has(dims.KM_WORDS[:1], dims.KM_SIGNS)
    return F.when(metres, 0.001).when(has(dims.KM_WORDS, dims.KM_SIGNS), 1.0)


def _factor(unit_id: Column, dimension: str, named: Column) -> Column:
    """What a unit is in the dimension's own: that of the unit id, or else of the one that the text names; null without either."""
    factor = F.when(unit_id == "", named)
    for uid, _, scale, dim in dims.UNITS:
        if dim == dimension:
            factor = factor.when(unit_id == uid, scale)
    return factor


def _scaled(sci: Column, with_id: Column, unit_id: Column, factor: Column) -> Column:
    number = text.first_number(F.when(unit_id == "", sci).otherwise(with_id))
    return text.bound(number, lambda n: F.when(factor < 1, n / (1 / factor)).otherwise(n * factor))  # thousandths by an exact division


def _measured(raw: Column, unit_id: Column, number: Column, unit: str | Column) -> Column:
    wrong = F.when(unit_id == "", "unparsed").when(unit_id.isin([u[0] for u in dims.UNITS]), "unit_dimension_mismatch").otherwise("unknown_unit")
    status = F.when(number.isNotNull(), "parsed").otherwise(wrong)
    value = F.when(number.isNotNull(), text.number_text(number)).otherwise(text.canonical_text(raw))
    return _value(value, F.when(number.isNotNull(), unit).otherwise(""), number, text.mapped(status, CONFIDENCE), status, F.nullif(unit_id, F.lit("")))


def _read(raw: Column, dimension: str, unit: str, named: Callable[[Column], Column]) -> Column:
    """A quantity's value: the text in a parser's form, the number with a unit id in it, the id, the factor, the number, each worked out once."""

    def of(sci: Column, found: Column) -> Column:
        def of_id(uid: Column) -> Column:
            factor = _factor(uid, dimension, text.bound(F.lower(sci), named))
            return text.bound(text.bound(factor, lambda f: _scaled(sci, found, uid, f)), lambda n: _measured(raw, uid, n, unit))

        return text.bound(_unit_id(found), of_id)

    return text.bound(text.scientific_text(raw), lambda sci: text.bound(_with_id(sci), lambda found: of(sci, found)))


def mass(raw: Column) -> Column:
    return _read(raw, "mass", "kg", _mass_factor)


def radius(raw: Column) -> Column:
    return _read(raw, "length", "km", lambda low: text.bound(_words(low), lambda words: _length_factor(low, words)))


def with_value(df: DataFrame, raw: Column, relation: Column, name: str) -> DataFrame:
    """The rows with ``normalized(raw, relation)`` as column ``name``."""
    return df.withColumn(name, normalized(raw, relation))


def gases(raw: Column, strict: bool = False) -> Column:
    """Formulas in canonical order, joined by ';'. Unless strict, a name also counts inside a longer word."""

    def named(t: Column, formula: str) -> Column:
        names = dims.GAS_NAMES[formula]
        whole = F.rlike(t, F.lit(r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(n) for n in names) + r")(?![a-z0-9])"))
        return whole if strict else text.contains_any(t, names) | whole

    def value(t: Column, found: Column) -> Column:
        renamed = F.exists(found, lambda g: ~F.contains(t, g))
        return F.when(F.size(found) > 0, _value(F.array_join(found, ";"), "component_set", None, 0.9, F.when(renamed, "synonym_normalized").otherwise("parsed"))).otherwise(_value(t, "", None, 0.2, "unparsed"))

    listed = lambda t: F.array_compact(F.array(*(F.when(named(t, g), g) for g in dims.GAS_ORDER)))
    return text.bound(text.canonical_text(raw), lambda t: text.bound(listed(t), lambda found: value(t, found)))


def plain(raw: Column) -> Column:
    return text.bound(text.canonical_text(raw), lambda t: F.when(t != "", _value(t, "", None, 0.5, "text_normalized")).otherwise(_value(t, "", None, 0.0, "empty")))


def normalized(raw: Column, relation: Column) -> Column:
    """The value of an object under its relation, as a struct."""
    return text.bound(raw, lambda r: F.when(relation == "HAS_MASS", mass(r)).when(relation == "HAS_RADIUS", radius(r)).when(relation == "HAS_ATMOSPHERE", gases(r)).otherwise(plain(r)))


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))


def equivalent(a: Column, b: Column, tolerance: float = dims.AUDIT_TOLERANCE) -> Column:
    """Numbers of one unit within the tolerance, or else equal non-empty normalised texts."""
    numbers = (a["normalized_unit"] != "") & (a["normalized_unit"] == b["normalized_unit"]) & a["numeric_value"].isNotNull() & b["numeric_value"].isNotNull()
    same = (a["normalized_value"] != "") & (a["normalized_value"] == b["normalized_value"])
    return F.coalesce(F.when(numbers, close(a["numeric_value"], b["numeric_value"], tolerance)).otherwise(same), F.lit(False))


def relative_difference(low: Column, high: Column) -> Column:
    return F.abs(high - low) / F.greatest(F.abs(high), F.abs(low), F.lit(1e-12))


def semantics_allow(relation: Column, context: Column) -> Column:
    """Whether the words around a quantity allow its reading as a mass or radius; other relations always pass."""
    low = F.lower(F.coalesce(context, F.lit("")))
    radius_ok = text.contains_any(low, dims.RADIUS_ALLOW) & ~text.contains_any(low, dims.RADIUS_REJECT)
    return F.when(relation == "HAS_RADIUS", radius_ok).when(relation == "HAS_MASS", text.contains_any(low, dims.MASS_ALLOW)).otherwise(True)


def radius_class(context: Column) -> Column:
    low = F.lower(F.coalesce(context, F.lit("")))
    return (
        F.when(text.contains_any(low, ("平均半径", "平均半徑", "mean radius")), "mean")
        .when(text.contains_any(low, ("赤道半径", "赤道半徑", "equatorial")), "equatorial")
        .when(text.contains_any(low, ("极半径", "極半徑", "polar")), "polar")
        .when(text.contains_any(low, ("半径", "半徑", "radius")), "generic")
        .otherwise("none")
    )


def quantity_score(relation: Column, raw: Column, obj: Column, pattern: Column) -> Column:
    """How good a candidate for the one value of a (subject, relation) is; -1 if its number is missing or not positive."""
    number = text.first_number(text.scientific_text(obj))
    low_raw, low_obj = F.lower(F.coalesce(raw, F.lit(""))), F.lower(F.coalesce(obj, F.lit("")))
    cls = radius_class(raw)
    for_radius = F.when(cls == "mean", 120).when(cls == "generic", 100).when(cls == "equatorial", 80).when(cls == "polar", 75).otherwise(0)
    for_radius = for_radius + F.when(text.contains_any(low_obj, ("km", "千米", "公里")), 30).when(F.rlike(low_obj, F.lit(r"\d\s*(m|米|au|ly|光年|kpc)")), 10).otherwise(0)
    for_mass = F.when(F.rlike(low_raw, F.lit(r"(质量|質量|mass)\s*(为|為|是|is|:|：)")), 120).when(text.contains_any(low_raw, ("质量", "質量", "mass")), 100).otherwise(0)
    for_mass = for_mass + F.when(text.contains_any(low_obj, ("kg", "千克", "公斤")), 30).when(text.contains_any(low_obj, ("质量", "mass")), 10).otherwise(0)
    origin = F.when(F.contains(F.coalesce(pattern, F.lit("")), F.lit("infobox")), 30).when(F.contains(F.coalesce(pattern, F.lit("")), F.lit("rule")), 5).otherwise(0)
    score = F.when(relation == "HAS_RADIUS", for_radius).otherwise(for_mass) + origin + 5
    return F.when(F.coalesce(number, F.lit(0.0)) > 0, score).otherwise(-1)


def relation_score(pattern: Column, raw: Column) -> Column:
    p = F.coalesce(pattern, F.lit(""))
    base = F.when(F.contains(p, F.lit("infobox")), 40).when(F.contains(p, F.lit("supplemental_narrative")), 10).when(F.contains(p, F.lit("rule")), 25).otherwise(0)
    return base + F.least(F.floor(F.length(F.coalesce(raw, F.lit(""))) / 40), F.lit(5))


def diameter_text(radius_km: Column) -> Column:
    return F.concat(F.format_number(2 * radius_km, 1), F.lit(" km"))


def stated(raw: Column, units: tuple[tuple[str, float], ...]) -> Column:
    """struct(number, unit, base) of the first unit of the ladder that a number in the text carries; null without any.

    A tolerance after the number (± or +/-) is passed over; base is the number in the ladder's base unit.
    """
    sci = text.scientific_text(raw)
    out = None
    for unit, factor in units:
        pattern = f"({text.NUMBER})" + r"\s*(?:(?:±|\+/-)\s*[\d.e+-]+\s*)?(?:倍)?\s*" + "(?i:" + re.escape(unit) + ")" + ("" if ord(unit[-1]) > 127 else r"(?![A-Za-z])")
        number = F.nullif(F.regexp_extract(sci, pattern, 1), F.lit("")).try_cast("double")
        one = F.struct(number.alias("number"), F.lit(unit).alias("unit"), (number * factor).alias("base"))
        out = F.when(number.isNotNull(), one) if out is None else out.when(number.isNotNull(), one)
    return out


def stated_mass(raw: Column) -> Column:
    return stated(raw, dims.MASS_UNITS)


def stated_length(raw: Column) -> Column:
    return stated(raw, dims.LENGTH_UNITS)
