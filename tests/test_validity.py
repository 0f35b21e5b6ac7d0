"""Faults of subjects and objects, audit statuses and ranking rules on odd rows."""

from factloom.functions import entity, validity
from factloom.operators import audit, evaluation, retrieval, triples
from pyspark.sql import functions as F

FACT = "subject string, relation string, object string, source_name string, raw string, pattern string"


def test_faults_of_odd_rows(spark):
    rows = [(None, None, None, "a", None, None), ("", "ORBITS", None, "a", "", ""), ("Mars", "ORBITS", "太阳", "a", "", ""), ("Mars", "ORBITS", "太阳", "a", "", ""), ("M" * 100_000, "IS_A", "行星" * 50_000, "a", "", "")]
    df = spark.createDataFrame(rows, FACT)
    assert [r.fault for r in triples.with_faults(df).orderBy(F.length("object")).collect()] == ["relation", "subject length", None, None, "subject length"]
    assert [r.fault for r in validity.with_fault(df.where("length(subject) > 9")).collect()] == ["explains"]
    assert triples.clean_triples(df, strict=True).count() == 2
    assert triples.with_faults(df.limit(0)).count() == 0


def statuses(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "", "") for r in rows], FACT).withColumns({c: F.lit("x") for c in ("source", "source_role", "origin", "schema_version", "source_title")})
    return {r.subject: list(r.statuses) for r in audit.statuses(df, ("zh_wikipedia", "nasa"), entity.alias_table(spark), **kw).collect()}


def test_audit_statuses_of_odd_rows(spark):
    assert statuses(spark, []) == {}
    assert statuses(spark, [(None, "IS_A", "x", "nasa"), (" ", "IS_A", "x", "nasa"), ("a", None, "x", "nasa"), ("b", "IS_A", "x", None)]) == {}
    assert statuses(spark, [("a", "IS_A", None, "nasa"), ("a", "IS_A", "", "zh_wikipedia")]) == {"a": ["exact_match"]}
    # One value of many in common: numbers within 0.2 %, of either sign, and next to nothing.
    many = [("n", "HAS_MASS", f"{k} kg", "nasa") for k in range(50, 80)] + [("n", "HAS_MASS", "79.1 kg", "zh_wikipedia"), ("n", "HAS_MASS", "2 kg", "zh_wikipedia")]
    assert statuses(spark, many) == {"n": ["unit_equivalent"]}
    assert statuses(spark, [("n", "HAS_MASS", "-5 kg", "nasa"), ("n", "HAS_MASS", "5 kg", "zh_wikipedia")]) == {"n": ["value_conflict"]}
    assert statuses(spark, [("n", "HAS_MASS", "3e-10 kg", "nasa"), ("n", "HAS_MASS", "-3e-10 kg", "zh_wikipedia")]) == {"n": ["unit_equivalent"]}
    # Without radii of the suspect source there is nothing to call cut short.
    assert statuses(spark, [("r", "HAS_RADIUS", "1 km", "nasa"), ("r", "HAS_RADIUS", "9 km", "esa")]) == {"r": ["source_missing", "value_conflict"]}


def test_numbers_meet_as_pair_by_pair(spark):
    numbers = [0.0, 1e-12, -1e-9, 4e-10, 1e-7, 1.002e-7, 1.0, 1.0019, 1.0021, -1.0, 999.0, 1000.9, 1001.1, 5e24, 5.009e24]
    rows = [(f"k{i}-{j}", "HAS_MASS", s, "kg", x) for i, a in enumerate(numbers) for j, b in enumerate(numbers) for s, x in (("a", a), ("b", b))]
    df = spark.createDataFrame(rows, "subject string, relation string, source_name string, unit string, number double")
    heads = df.where("source_name = 'a'").select("subject", "relation", "source_name")
    found = {r.subject for r in audit._numbers_meet(df, heads, ["subject", "relation", "source_name"], 0.002).where("source_name = 'b'").collect()}
    assert found == {f"k{i}-{j}" for i, a in enumerate(numbers) for j, b in enumerate(numbers) if abs(a - b) <= max(0.002 * max(abs(a), abs(b)), 1e-9)}


def test_scores_and_terms(spark):
    df = spark.createDataFrame([("火星", "火星", "火星 有 大气"), ("火星的大气", "火星", "x"), (None, None, None), ("", "a", "b")], "q string, title string, content string")
    assert [r[0] for r in df.select(retrieval.fallback_score(F.col("q"), F.col("content"), F.col("title"))).collect()] == [1012, 300, 0, 0]
    asked = spark.createDataFrame([("火星 的 大气 Mars 2020  x", ["火星"]), (None, None), ("大气 大气", None)], "q string, e array<string>")
    assert [r[0] for r in asked.select(entity.topic_terms(entity.segments(F.col("q")), F.col("e"))).collect()] == [["大气", "Mars 2020 x"], [], ["大气"]]


def test_known_issues_and_summary(spark):
    runs = spark.createDataFrame([(1, True), (2, True), (2, None)], "id int, consistency_match boolean")
    got = {r.id: r.status for r in evaluation.known_issues(spark.createDataFrame([(1,), (2,), (3,)], "id int"), runs).collect()}
    assert got == {1: "resolved", 2: "open", 3: "not_observed"}
    t = spark.createDataFrame([("a", "f"), ("a", "f"), ("b", None)], "source_name string, file string")
    assert {tuple(r) for r in evaluation.load_summary(t, t.limit(0), "file").collect()} == {("a", 2, 0, 1), ("b", 1, 0, 0)}


def test_quantities_and_numbers_by_their_parts(spark):
    cases = [("3,389.5 km", None), ("1 km", None), ("1,2,3 km", None), ("12km", None), ("1.5,2 km", "form"), ("5. km", "form"), (".5 km", "form"), (",5 km", "form"), ("1.2.3 km", "form"), ("km", "form"), ("12", "form"), ("3e5 km", "form"), ("-3 km", "form"), ("0 km", "zero"), ("0.00 km", "zero"), ("9" * 39 + " km", "long"), ("", "empty"), ("2 天文单位", None)]
    df = spark.createDataFrame(cases, "o string, f string")
    assert [r.got for r in df.select(validity.quantity_fault(F.col("o"), ("km", "AU", "天文单位"), False).alias("got")).collect()] == [f for _, f in cases]
    cases = [("5.97 × 10 24 kg", None), ("5.97×1024 kg", None), ("5.97e24 kg", None), ("1E-3kg", None), ("5 e24 kg", "form"), ("5 × 24 kg", "form"), ("5×10 kg", "form"), ("5 地球质量", None)]
    df = spark.createDataFrame(cases, "o string, f string")
    assert [r.got for r in df.select(validity.quantity_fault(F.col("o"), ("kg", "地球质量"), True).alias("got")).collect()] == [f for _, f in cases]
    cases = [("≈ 3,389 km", True), ("1.5×10^24 kg", True), ("12-14", True), ("3/4", True), ("(5)", True), ("80%", True), ("1846", True), ("1846-9-23", True), ("1846年9月23日", True), ("1846/9", True), ("12年", False), ("1846年13月", False), ("Mars", False), ("x", False), ("kg", False), ("", False), (None, False), ("火星 2", False)]
    df = spark.createDataFrame(cases, "o string, f boolean")
    assert [r.got for r in df.select(validity.stated_number(F.col("o")).alias("got")).collect()] == [f for _, f in cases]


def test_discoverers_by_what_names_are_made_of(spark):
    cases = [("Asaph Hall", None), ("伽利略", None), ("约翰·亚当斯", None), ("威廉·赫歇尔 和 卡罗琳", None), ("由伽利略", "word"), ("他们", "word"), ("因此人", "word"), ("1846", "dated"), ("九月", "dated"), ("X", "length"), ("··", "length"), ("望远镜小组", "word"), ("éé", "sign"), ("", "empty")]
    df = spark.createDataFrame(cases, "o string, f string")
    assert [r.got for r in df.select(validity.discoverer_fault(F.col("o"), validity.noise(F.col("o"))).alias("got")).collect()] == [f for _, f in cases]


def test_the_strict_profile(spark):
    cases = [
        ("IS_A", "矮行星", None), ("IS_A", "", "empty"), ("IS_A", None, "empty"), ("IS_A", "行星，大", "mark"), ("IS_A", "因为行星", "reason"), ("IS_A", "第2类行星", "number"), ("IS_A", "(行星)", "mark"), ("IS_A", "由岩石组成", "describes"), ("IS_A", "由组成", None),
        ("ORBITS", "Kepler-22 b", None), ("ORBITS", "1846", "number"), ("ORBITS", "a b c d e f g h i j k", "long"), ("ORBITS", "Mars_1", "sign"), ("PART_OF", "位于太阳系", "describes"),
        ("HAS_MASS", "6.4e23 kg", None), ("HAS_MASS", "6.4", "quantity"), ("HAS_MASS", "kg", "quantity"), ("HAS_RADIUS", "3389 km", None), ("HAS_RADIUS", "3,389 km", "mark"), ("HAS_RADIUS", "约3389 km", "quantity"),
        ("HAS_ATMOSPHERE", "CO2", None), ("HAS_ATMOSPHERE", "二氧化碳", None), ("HAS_ATMOSPHERE", "空气", "gas"), ("HAS_ATMOSPHERE", "95%", "number"),
        ("DISCOVERED_BY", "伽利略", None), ("DISCOVERED_BY", "威廉·赫歇尔", None), ("DISCOVERED_BY", "Asaph Hall", None), ("DISCOVERED_BY", "A B C D E", "shape"), ("DISCOVERED_BY", "天文学家", "word"), ("DISCOVERED_BY", "威廉的人", "word"), ("DISCOVERED_BY", "一二三四五", "shape"), ("DISCOVERED_BY", "年 某人", "word"), ("DISCOVERED_BY", "Hall 2", "shape"), (None, "行星", None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r string, o string, f string")
    got = {r.i: r.got for r in df.select("i", validity.strict_fault(F.col("r"), F.col("o")).alias("got")).collect()}
    assert {cases[i]: g for i, g in got.items() if g != cases[i][2]} == {}
