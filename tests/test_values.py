"""Quantities, entities, measurement kinds: golden values."""

import pytest
from factloom.functions import entity, quantity, text
from pyspark.sql import functions as F


def values(spark, rows, relation):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    return [r.v for r in df.select("i", quantity.normalized(F.col("raw"), F.lit(relation)).alias("v")).orderBy("i").collect()]


def test_masses(spark):
    got = values(spark, ["6.4171e23 kg", "6.4169 × 10 23 kg", "5.972 37 × 10 24 千克", "1 Jupiter mass", "1 Earth mass", "641.691 Q613726", "3 Q999999999", "3 Q828224", "no number kg", None], "HAS_MASS")
    assert [g.numeric_value for g in got[:3]] == pytest.approx([6.4171e23, 6.4169e23, 5.97237e24])
    assert {g.normalized_unit for g in got[:5]} == {"kg"} and got[3].numeric_value > got[4].numeric_value
    assert got[5].numeric_value == pytest.approx(6.41691e23) and got[5].unit_id == "Q613726"
    assert [g.parse_status for g in got[6:]] == ["unknown_unit", "unit_dimension_mismatch", "unparsed", "unparsed"]


def test_radii(spark):
    got = values(spark, ["3389.5 km", "3389.5 千米", "3389500 m", "3389.50 Q828224", "3389公里km", "12 leagues", "1,737.4 km"], "HAS_RADIUS")
    assert [g.numeric_value for g in got] == [3389.5, 3389.5, 3389.5, 3389.5, 3389.0, None, 1737.4]
    assert got[0].normalized_value == "3389.5" and got[5].parse_status == "unparsed"


def test_gases(spark):
    got = values(spark, ["CO2, nitrogen, argon, water vapor", "二氧化碳；氮气", "the carbon", "rock"], "HAS_ATMOSPHERE")
    assert [g.normalized_value for g in got] == ["CO2;N2;Ar;H2O", "CO2;N2", "Ar;He", "rock"]  # names count inside words, as documented
    assert got[0].normalized_unit == "component_set" and got[0].parse_status == "synonym_normalized"
    strict = spark.createDataFrame([("the carbon",)], "raw string").select(quantity.gases(F.col("raw"), strict=True).alias("v")).first().v
    assert strict.normalized_value == "the carbon"


def test_number_text(spark):
    values_ = [3389.5, 6.4171e23, 1.0, 0.0, -2.5e-7, 0.0001, 123456789012.0, 1234567890123.0, 1e100, -0.1, 100.0, 9.99999999999951]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], "i int, v double")
    got = [r.t for r in df.select("i", text.number_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [f"{v:.12g}" for v in values_]


def test_entities(spark):
    df = spark.createDataFrame([("Moon",), ("月球",), ("q405",), (" the  moon ",), ("Q999",), ("nowhere",), (None,)], "name string")
    got = {r.name: (r.canonical_id, r.parse_status) for r in entity.with_entity(df, "name", entity.alias_table(spark)).collect()}
    assert {got[n][0] for n in ("Moon", "月球", "q405", " the  moon ")} == {"Q405"}
    assert got["Q999"] == ("Q999", "qid_unknown_alias") and got["nowhere"] == ("", "unmapped_entity") == got[None]
    groups = spark.createDataFrame([(1, "a", "Q2", 0), (1, "b", "Q2", 1), (2, "a", "Q2", 2), (2, "b", "Q405", 3), (3, "a", "", 4)], "k int, source string, canonical_id string, ordinal int")
    assert {r.k: r.equivalent for r in entity.groups_equivalent(groups, ["k"], "source", "canonical_id", "ordinal").collect()} == {1: True, 2: False, 3: False}


def test_measurement_kinds(spark):
    rows = [("HAS_RADIUS", "Volumetric mean radius"), ("HAS_RADIUS", "平均半径"), ("HAS_RADIUS", "Equatorial  radius"), ("HAS_RADIUS", "极半径"), ("HAS_RADIUS", "x"), ("ORBITS", "Distance from Sun"), ("ORBITS", "Sun"), ("OTHER", "semi-major axis"), ("HAS_MASS", "moon")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, relation string, t string")
    got = [r.m for r in df.select("i", entity.measurement_kind(F.col("relation"), F.col("t")).alias("m")).orderBy("i").collect()]
    assert [g.kind for g in got] == ["volumetric_mean_radius", "mean_radius", "equatorial_radius", "polar_radius", "unknown", "orbital_distance", "orbit_target", "semi_major_axis", "satellite_mass"]
    assert got[5].warning and not got[6].warning


def test_routes(spark):
    rows = ["Mars mass?", "What orbits?", "Rosetta mission", "为什么 发光", "为什么 质量", "hello", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, q string")
    got = [r.r for r in df.select("i", entity.route(F.col("q")).alias("r")).orderBy("i").collect()]
    assert [g.sources[0] for g in got] == ["nasa", "wikidata", "esa", "zh_wikipedia", "nasa", "nasa", "nasa"]
    assert got[4].sources == ["nasa", "wikidata", "zh_wikipedia", "esa"] and got[4].intent == "mixed_numeric_narrative"


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.entity_name(F.lit("Mars_(planet)#Moons  x"))) == "Mars (planet)"
    assert one(text.object_text(F.lit(" 伽利略 （意大利人） "))) == "伽利略"
    assert one(text.safe_name(F.lit(" it's；x "))) == "it\\'s;x"
    assert one(text.quantity_key(F.lit("6.4 × 10，23 KG"))) == "6.4x1023kg"
    assert one(text.percent_claims(F.lit("95% and 3 % and 95%"))) == ["3 %", "95%"]
    assert one(text.redact(F.lit("key sk-abcdefgh12345"))) == "key sk-***"
    assert one(text.display_value(F.lit("5"), F.lit("km"))) == "5 km" and one(text.display_value(F.lit("5 km"), F.lit("km"))) == "5 km"
    assert one(text.excerpt(F.lit("a" * 300))) == "a" * 200 + "..."
    assert one(text.answer_text(F.lit("<think>no</think>One. Two! Three? Four. Five. Six. Seven."))) == "One. Two! Three? Four. Five. Six."
    assert one(text.utc_timestamp(F.lit("nonsense"))) is None
    assert one(text.unit_name(F.lit(" Kilometres "))) == "km"
    assert one(text.strip_markers(F.lit("7001♠3389 公里"))) == "3389 km"
    assert one(text.scalar_number(F.lit("1,234.5 (approx) km"))) == "1234.5"
    assert len(one(text.short_id(F.lit("a"), F.lit(None)))) == 12
    assert one(quantity.diameter_text(F.lit(6371.025))) == "12,742.0 km"


def test_stated_quantities_and_anchors(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    got = one(quantity.stated_mass(F.lit("约为 0.107 ± 0.001 倍地球质量")))
    assert (got.number, got.unit) == (0.107, "地球质量") and got.base == pytest.approx(0.107 * 5.97237e24)
    assert one(quantity.stated_mass(F.lit("mass 6.4 × 10^23 kg"))).base == pytest.approx(6.4e23)
    assert one(quantity.stated_length(F.lit("1.5 AU away, 3 km wide"))).unit == "AU" and one(quantity.stated_length(F.lit("12 leagues"))) is None
    assert one(entity.anchor(F.lit("在木星系统内"))) == "木星系统" and one(entity.anchor(F.lit("nowhere"))) is None
    assert one(entity.anchored(F.lit("ORBITS"), F.lit("围绕火星"), F.lit("它绕火星运行"))) == "火星"
    assert one(entity.anchored(F.lit("IS_A"), F.lit("火星人"), F.lit("绕"))) == "火星人" and one(entity.anchored(F.lit("ORBITS"), F.lit("围绕火星"), F.lit(None).cast("string"))) == "围绕火星"


def test_times_without_a_zone_are_utc(spark):
    from factloom.functions import text
    from pyspark.sql import functions as F

    cases = [("2024-03-01T12:00:00Z", 1709294400), ("2024-03-01T12:00:00+02:00", 1709287200), ("2024-03-01T12:00:00", 1709294400), ("2024-03-01 12:00:00.5", 1709294400), ("2024-03-01", 1709251200), ("no", None), ("", None), (None, None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        rows = spark.createDataFrame(cases, "s string, t long").select(F.unix_timestamp(text.utc_timestamp(F.col("s"))).alias("got"), "t").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.got for r in rows] == [t for _, t in cases]
