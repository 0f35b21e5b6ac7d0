import re

import pytest
from factloom.operators import extraction
from factloom.operators import templates as t
from pyspark.sql import functions as F


def facts(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, title string, sentence string")
    return {(r.subject, r.relation, r.object) for r in t.page_facts(df, "title", "sentence", "n", **kw).collect()}


def test_page_templates(spark):
    rows = [
        ("火星", "火星的平均半径约为3,389.5 km。"), ("火星", "火星质量为6.4×10^23 kg。"), ("火星", "火星的大气层主要由二氧化碳、95% 氮和氩组成。"), ("火卫一", "火卫一围绕火星公转。"), ("火卫二", "火卫二是火星的天然卫星。"),
        ("谷神星", "谷神星是一颗矮行星。"), ("谷神星", "谷神星位于小行星带。"), ("木卫一", "木卫一由伽利略于1610年发现。"), ("木卫二", "1610年伽利略发现了木卫二。"), ("地球", "地球属于太阳系。"),
        ("火星", "此外火星的平均半径约为3,389.5 km。"), ("火星", "金星质量为4.9e24 kg。"), ("火星", None), (None, "火星质量为1 kg啊啊啊。"), ("火星", "短"),
    ]
    found = facts(spark, rows)
    want = {
        ("火星", "HAS_RADIUS", "3,389.5 km"), ("火星", "HAS_MASS", "6.4×10^23 kg"), *(("火星", "HAS_ATMOSPHERE", g) for g in ("二氧化碳", "氮和氩")), ("火卫一", "ORBITS", "火星"), ("火卫二", "ORBITS", "火星"),
        ("谷神星", "IS_A", "矮行星"), ("谷神星", "LOCATED_IN", "小行星带"), ("木卫一", "DISCOVERED_BY", "伽利略"), ("地球", "PART_OF", "太阳系"),
    }
    assert want <= found, want - found
    assert not [f for f in found if f[0] == "金星" or f[2] == "1 kg"]


def test_sentence_templates_take_their_first_match(spark):
    rows = [(1, "火星绕太阳公转，木星绕太阳公转", None), (2, "木星拥有95颗已知卫星", None), (3, "它的质量为5 kg", ["它的"]), (4, "x" * 30 + "的半长轴为1.5", None), (5, "水星的半长轴为0.387 AU", None), (6, None, None)]
    df = spark.createDataFrame(rows, "id int, sentence string, entities array<string>")
    got = {(r.id, r.relation, r.subject, r.object) for r in t.sentence_facts(df, ["id"], "sentence", entities="entities").collect()}
    assert {(1, "围绕", "火星", "太阳"), (2, "拥有卫星", "木星", "95"), (5, "拥有轨道参数", "水星", "0.387")} <= got
    assert not [g for g in got if g[2] == "木星" and g[0] == 1]


@pytest.mark.parametrize("kind", [t.PAGE, t.SENTENCE])
def test_cues_are_in_every_match(kind):
    for x in kind:
        assert x.cue and all(x.cue), x.form
        assert re.sub(r"\{[so][^}]*\}|\{\.\.\.\}", "", x.form)
    assert len(t.PAGE) >= 18 and len(t.SENTENCE) == 28


def test_one_scan(spark, tmp_path):
    spark.createDataFrame([("火星", "火星绕太阳公转。", 1)], "title string, sentence string, n int").write.parquet(f"{tmp_path}/s")
    out = t.page_facts(spark.read.parquet(f"{tmp_path}/s"), "title", "sentence", "n")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_a_form_needs_both_slots():
    with pytest.raises(ValueError):
        t.Template("X", "{s}是")


def test_candidates_are_all_matches_in_order(spark):
    x = t._set([("OF", "{s:word} of {the |}{o:word}"), ("AND", "{s:word} and {o:word}")])
    df = spark.createDataFrame([("cup of tea and pot of the coffee and milk",)], "s string")
    rows = t.matches(df, "s", x).select("rule", "at", "subject", "object").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "cup", "tea"), (0, 1, "pot", "coffee"), (1, 0, "tea", "pot"), (1, 1, "coffee", "milk")]
    assert df.select(F.size(t._candidates(F.col("s"), x, True))).first()[0] == 2


def test_older_entities_and_key_values(spark):
    df = spark.createDataFrame([("火星质量为6.4×10^23 kg，表面温度-60到20 °C，赤道半径 3,396公里，半径3389 km", ["火星", "的", " 金星 ", "a", "x。y", "51 Pegasi b", "2020"]), (None, None)], "s string, t array<string>")
    rows = df.select(extraction.entities(F.col("s"), F.col("t")).alias("e"), extraction.key_values(F.col("s")).alias("k"), extraction.mixture(F.col("s")).alias("m")).collect()
    of = lambda kind: [x.name for x in rows[0].e if x.type == kind]
    assert of("entity") == ["火星", "金星", "51 Pegasi b"] and of("value") == ["6.4×10^23kg", "20°C", "3,396公里"] and of("value_range") == ["-60到20 °C"]
    assert of("parameter") == ["质量", "半径", "表面温度", "赤道半径"]
    assert [(x.parameter, x.value) for x in rows[0].k] == [("质量", "6.4×10^23kg"), ("表面温度", "-60"), ("赤道半径", "3,396公里"), ("半径", "3389")]
    assert rows[1].e == [] and rows[1].k == [] and rows[1].m is None
    mixed = spark.createDataFrame([("CO2占95.3%、N2 占 2.7 %、CO2 5%",), ("CO2 5%",)], "s string").select(extraction.mixture(F.col("s")).alias("m")).collect()
    assert mixed[0].m == {"N2": "2.7%", "CO2": "5%"} and mixed[1].m is None
