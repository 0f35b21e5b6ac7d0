"""Operators on small fixtures: null, empty, tied and repeated rows, and the rules of each."""

from factloom.functions import web
from factloom.operators import audit, evaluation, extraction, fusion, graph, quality, retrieval, triples
from factloom.sources import tables
from pyspark.sql import functions as F

FACTS = "subject string, relation string, object string, source_name string, source_title string, source_field string, ordinal bigint"


def facts(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], FACTS)


def statuses(spark, rows):
    return {(r.subject, r.fusion_status) for r in fusion.fuse(facts(spark, rows)).collect()}


def test_fusion_statuses(spark):
    rows = [
        ("Mars", "HAS_MASS", "6.4171e23 kg", "nasa", "", ""), ("Mars", "HAS_MASS", "641.71 Q613726", "wikidata", "", ""),
        ("Phobos", "HAS_RADIUS", "11.1 km", "a", "", ""), ("Phobos", "HAS_RADIUS", "11.2 km", "b", "", ""),
        ("Jupiter", "HAS_RADIUS", "69911 km", "a", "", "mean radius"), ("Jupiter", "HAS_RADIUS", "71492 km", "b", "", "equatorial radius"),
        ("Venus", "HAS_RADIUS", "1.0 km", "a", "", ""), ("Venus", "HAS_RADIUS", "6051.8 km", "b", "", ""),
        ("Moon", "ORBITS", "Earth", "a", "", ""), (None, "ORBITS", "x", "a", "", ""), ("x", " ", "x", "a", "", ""),
    ]
    assert statuses(spark, rows) == {("Mars", "multi_source_agreement"), ("Phobos", "near_equivalent_values"), ("Jupiter", "same_quantity_different_measurement_kind"), ("Venus", "human_review_required"), ("Moon", "single_source_only")}
    fused = fusion.fuse(facts(spark, rows))
    merged = [r for r in fusion.fused_records(fused).collect() if r.subject == "Mars"]
    assert len(merged) == 1 and merged[0].sources == ["nasa", "wikidata"] and merged[0].ordinal == 0
    assert fusion.fuse(facts(spark, rows).limit(0)).count() == 0


def test_clean_and_choose(spark):
    rows = [
        (0, "Mars", "HAS_RADIUS", "3389.5 km", "infobox", "mean radius: 3389.5 km"), (1, "Mars", "HAS_RADIUS", "3396 km", "rule_1", "equatorial radius 3396 km"),
        (2, "Mars", "HAS_RADIUS", "6779 km", "rule", "diameter 6779 km radius"), (3, "Mars", "ORBITS", " Sun。", "infobox", ""), (4, "Mars", "ORBITS", "Sun", "rule", ""),
        (5, "x", "ORBITS", "Sun", "", ""), (6, "Mars", "LIKES", "Sun", "", ""), (7, "Mars", "IS_A", "", "", ""), (8, None, "IS_A", "planet", "", ""), (9, "Mars", "HAS_MASS", "none", "", "mass"),
    ]
    df = spark.createDataFrame(rows, "ordinal bigint, subject string, relation string, object string, pattern string, raw string")
    clean = triples.clean_triples(df)
    assert sorted(r.ordinal for r in clean.collect()) == [0, 1, 3, 4]
    best = {(r.relation, r.object): r.ordinal for r in triples.best_triples(clean).collect()}
    assert best == {("HAS_RADIUS", "3389.5 km"): 0, ("ORBITS", "Sun"): 3}
    first = triples.first_of(df.unionByName(df), ["subject", "relation"])
    assert first.count() == 7 and first.columns == df.columns
    assert {r.ordinal for r in triples.first_of(df, ["subject", "relation"], last=True).where("subject = 'Mars' and relation = 'HAS_RADIUS'").collect()} == {2}


def test_normalize_records(spark):
    df = spark.createDataFrame([(" Mars ", "ORBITS", "Sun", "old page", None), (None, None, None, None, "html")], "subject string, relation string, object string, source string, origin string")
    got = triples.normalize_triples(df, "nasa", active=False).collect()
    assert got[0].source_title == "old page" and got[0].schema_version == "nasa_shadow_ready_v1" and got[0].subject == "Mars" and got[0].origin == "api"
    assert got[1].subject == "" and got[1].origin == "html_fallback"
    gaps = triples.missing_fields(triples.normalize_triples(df, "nasa")).collect()
    assert gaps[0].missing_fields == ["source_role"] and not gaps[0].complete
    chunks = spark.createDataFrame([("T", "s", "c", "a, b，c")], "page_title string, section string, content string, keywords string")
    assert triples.normalize_narratives(chunks, "nasa").first().keywords == ["a", "b", "c"]


def test_hops(spark):
    e = spark.createDataFrame([("Phobos", "ORBITS", "Mars", "a", 0), ("Mars", "HAS_MASS", "6e23 kg", "a", 1), ("Mars", "IS_A", "planet", "a", 2), ("Deimos", "DISCOVERED_BY", "Hall", "a", 3), ("Phobos", "DISCOVERED_BY", "Hall", "a", 4), ("Deimos", "PART_OF", "Mars system", "a", 5)], "subject string, relation string, object string, source_name string, ordinal bigint")
    inferred = spark.createDataFrame([("Deimos", "Mars"), ("Phobos", "wrong")], "subject string, host string")
    got = {(r.subject, r.parameter, r.value) for r in graph.host_parameter(e, "ORBITS", ["HAS_MASS", "IS_A"], inferred).collect()}
    assert got == {(s, p, v) for s in ("Phobos", "Deimos") for p, v in (("HAS_MASS", "6e23 kg"), ("IS_A", "planet"))}
    assert {r.subject for r in graph.having_all(e, [("DISCOVERED_BY", "Hall"), ("PART_OF", "Mars system")]).collect()} == {"Deimos"}
    touch = graph.either_endpoint(e.unionByName(e.limit(0)), spark.createDataFrame([("Mars",), ("Mars",), (None,)], "entity string"))
    assert sorted(r.ordinal for r in touch.collect()) == [0, 1, 2]
    assert {r.name: r.degree for r in graph.degrees(e).collect()}["Mars"] == 3
    links = e.select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    seen = {r.node: r.depth for r in graph.reachable(links, spark.createDataFrame([("Phobos",)], "node string"), 5).collect()}
    assert seen == {"Phobos": 0, "Mars": 1, "Hall": 1, "6e23 kg": 2, "planet": 2}
    assert graph.induced(e, spark.createDataFrame([("Phobos",), ("Mars",)], "name string")).count() == 1


def test_audit_generations(spark):
    rows = [("A", "HAS_RADIUS", "3389.5 km", "a", "", ""), ("A", "HAS_RADIUS", "3389500 m", "b", "", ""), ("B", "HAS_RADIUS", "10 km", "a", "", ""), ("B", "HAS_RADIUS", "10 km", "b", "", ""), ("C", "HAS_RADIUS", "1 km", "a", "", ""), ("C", "HAS_RADIUS", "6051 km", "b", "", ""), ("D", "HAS_RADIUS", "100 km", "a", "", ""), ("D", "HAS_RADIUS", "105 km", "b", "", ""), ("E", "HAS_RADIUS", "7 km", "a", "", "")]
    per = audit.by_source(facts(spark, rows))
    assert {r.subject: r.status for r in audit.status_v1(per).collect()} == {"A": "unit_equivalent", "B": "exact_match", "C": "value_conflict", "D": "value_conflict"}
    assert {r.subject: r.status for r in audit.status_v2(per).collect()}["C"] == "source_extraction_error"
    assert {r.subject: r.status for r in audit.status_v3(per).collect()}["D"] == "measurement_kind_difference"
    missing = audit.missing_sources(facts(spark, rows), ["a", "b"])
    assert [(r.subject, r.source_name) for r in missing.collect()] == [("E", "b")]


def test_review_workflow(spark):
    items = spark.createDataFrame([("p1", "approved", "ok", True, "add_alias", "add_alias", "none", "metadata_only", False), ("p2", "approved", None, True, "add_alias", "add_alias", "none", "metadata_only", False), ("p3", "pending", None, True, "add_alias", None, "none", "metadata_only", False), ("p4", "approved", "ok", False, "replace_value", "replace_value", "validated", "value_change", True), ("p5", "approved", "ok", False, "replace_value", "other", "none", "value_change", False), ("p6", "approved", "ok", True, "a", "a", "applied", "metadata_only", False)], "patch_id string, human_decision string, human_reason string, safe boolean, action string, approved_action string, revision_status string, change_type string, allow_value_change boolean")
    got = {r.patch_id: (r.outcome, r.errors) for r in quality.plan(items).collect()}
    assert got["p1"] == ("apply", []) and got["p2"] == ("blocked", ["no_reason"]) and got["p3"][0] == "skip_pending" and got["p4"][0] == "apply" and got["p6"][0] == "skip_applied"
    assert got["p5"] == ("blocked", ["action_mismatch", "value_change_not_allowed", "revision_not_validated"])
    records = spark.createDataFrame([("M", "R", "old", "a", 0), ("M", "R", "new", "a", 1), ("M", "S", "old", "a", 2)], "subject string, relation string, object string, source_name string, ordinal bigint")
    change = spark.createDataFrame([("p", "M", "R", "old", "new")], "patch_id string, subject string, relation string, old_object string, new_object string")
    assert quality.preflight(records, change).first().would_create_duplicate
    after = quality.apply_changes(records, change)
    assert sorted((r.object, r.ordinal, r.changed) for r in after.collect()) == [("new", 0, True), ("old", 2, False)]
    m = quality.manifest(records, after).first()
    assert (m.n_before, m.n_after) == (3, 2) and m.digest_before != m.digest_after


def test_chunks(spark):
    s = "x" * 99 + "."
    rows = [(0, None), (1, "short."), (2, s * 2), (3, s * 17 + "tail."), (4, "y" * 30 + "." + "z" * 790 + "." + s * 2)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", extraction.packed_chunks(F.col("t"), ".").alias("c"))
    got = {r.i: [len(x) for x in r.c] for r in df.collect()}
    assert got == {0: [], 1: [], 2: [200], 3: [800, 905], 4: [791, 200]}


def test_extraction_and_keywords(spark):
    df = spark.createDataFrame([("Mars", "Mars orbits Sun. Mars orbits Sol."), ("None", None)], "title string, text string")
    got = extraction.rule_triples(df, "title", "text", [("ORBITS", r"orbits (\w+)")]).collect()
    assert [(r.subject, r.object, r.ordinal) for r in got] == [("Mars", "Sun", 0), ("Mars", "Sol", 1)]
    assert [r.object for r in extraction.first_hit_facts(df, "title", "text", [("ORBITS", r"orbits (\w+)")]).collect()] == ["Sun"]
    words = retrieval.keyword_counts(df, "title", "text", 2).orderBy("rank").collect()
    assert [(r.word, r.n) for r in words] == [("mars", 2), ("orbits", 2)]
    parts = spark.range(1).select(extraction.components(F.lit("95% CO2, 3 % N2 and argon")).alias("p")).first().p
    assert parts == ["CO2", "N2", "argon"]


def test_html_columns(spark):
    html = '<title> A  b </title><table><tr><th>Mass (10^24 kg)</th><td>0.64</td></tr><tr><td>only</td></tr></table><a href="/x#f">x</a><a class="c" href="http://e.org/y">y</a><script>no</script>&amp; caf&eacute;'
    df = spark.createDataFrame([(html,), (None,)], "h string")
    r = df.select(web.title(F.col("h"), "none").alias("t"), web.links(F.col("h")).alias("l"), web.plain_text(F.col("h")).alias("p"), web.table_rows(F.col("h")).alias("r")).collect()
    assert r[0].t == "A b" and r[0].l == ["/x", "http://e.org/y"] and r[0].p.endswith("& café") and "no" not in r[0].p
    assert [(x.field, x.value) for x in r[0].r] == [("Mass (10^24 kg)", "0.64")]
    assert r[1].t == "none" and r[1].l == [] and r[1].p == ""
    url = spark.createDataFrame([("https://a.b.org/p/q.html?x#y",)], "u string").select(web.host(F.col("u")).alias("h"), web.allowed(F.col("u"), ["b.org"]).alias("ok"), web.absolute(F.col("u"), F.lit("z")).alias("z"), web.absolute(F.col("u"), F.lit("/z")).alias("rz")).first()
    assert tuple(url) == ("a.b.org", True, "https://a.b.org/p/z", "https://a.b.org/z")


def test_retrieval_scores(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<float>")
    v = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "vec_id int, embedding array<float>")
    got = {r.vec_id: r.score for r in retrieval.vector_top_k(q, v, 9).collect()}
    assert got[1] == 1.0 and got[2] == 0.5 and got[3] == 0.0
    a = spark.createDataFrame([("c1", 0.9, "", "t"), ("c2", 0.1, "s", None)], "id string, score double, section string, title string")
    b = spark.createDataFrame([("c1", 0.2, "sec", "other"), ("c3", 0.3, "x", "y")], "id string, score double, section string, title string")
    got = {r.id: (r.score, r.section, r.title) for r in fusion.merge_candidates(a, b, "id", "score").collect()}
    assert got == {"c1": (0.9, "sec", "t"), "c2": (0.1, "s", None), "c3": (0.3, "x", "y")}


def test_evaluation(spark):
    r = spark.createDataFrame([("a", "pass", True, 1), ("a", "missed", True, 0), ("b", "pass", False, 0)], "category string, failure string, expects boolean, hit int")
    s = evaluation.summary(r, F.col("expects"), F.col("hit")).first()
    assert (s.n_total, s.n_passed, s.exact_accuracy, s.top_k_hit_rate) == (3, 2, 0.6667, 0.5)
    g = {x.gate: x.passed for x in evaluation.gates(evaluation.summary(r, F.col("expects"), F.col("hit")), {"exact_accuracy": 0.8}, {"n_total": 3}).collect()}
    assert g == {"exact_accuracy": False, "n_total": True}


def test_sources(spark, tmp_path):
    import json

    triple = [{"subject": "Mars", "relation": "ORBITS", "object": "Sun"}, {"subject": "Mars", "relation": "IS_A", "object": "planet", "confidence": 0.5}]
    (tmp_path / "Mars_triples.json").write_text(json.dumps(triple))
    (tmp_path / "Bad_triples.json").write_text("[{")
    got = tables.read_triples(spark, str(tmp_path / "*_triples.json")).collect()
    assert sorted((r.subject, r.object, r.file_title) for r in got) == [("Mars", "Sun", "Mars"), ("Mars", "planet", "Mars")]
    (tmp_path / "Abc_triples.json").write_text(json.dumps([{"subject": "first", "relation": "IS_A", "object": "x"}] * 2))
    got = tables.read_triples(spark, str(tmp_path / "*_triples.json")).orderBy("ordinal").collect()
    assert [(r.file_title, r.object) for r in got] == [("Abc", "x"), ("Abc", "x"), ("Mars", "Sun"), ("Mars", "planet")] and len({r.ordinal for r in got}) == 4
    bundle = {"source_name": "esa", "records": [{"title": "T", "triples": triple, "narratives": [{"page_title": "T", "section": "s", "content": "c", "keywords": ["k"]}]}]}
    (tmp_path / "bundle.json").write_text(json.dumps(bundle))
    t, n = tables.read_bundle(spark, str(tmp_path / "bundle.json"))
    assert t.count() == 2 and n.first().keywords == ["k"]
    claims = {"entities": {"Q111": {"labels": {"en": {"value": "Mars"}}, "claims": {"P2067": [{"id": "c", "mainsnak": {"datavalue": {"value": {"amount": "+641.71", "unit": "http://x/Q613726"}}}}], "P31": [{"id": "d", "mainsnak": {"datavalue": {"value": {"id": "Q634"}}}}], "P9": []}}}}
    (tmp_path / "q.json").write_text(json.dumps(claims))
    got = {(r.label, r.relation, r.value) for r in tables.read_claims(spark, str(tmp_path / "q.json"), {"P2067": "HAS_MASS", "P31": "IS_A"}).collect()}
    assert got == {("Mars", "HAS_MASS", "641.71 Q613726"), ("Mars", "IS_A", "Q634")}
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source_name string, x int")
    out = str(tmp_path / "ns")
    tables.write_namespaced(df, out)
    tables.write_namespaced(spark.createDataFrame([("a", 3)], "source_name string, x int"), out)
    assert sorted((r.source_name, r.x) for r in spark.read.parquet(out).collect()) == [("a", 3), ("b", 2)]


def test_upsert_and_cascade(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, name string, v string")
    new = spark.createDataFrame([(2, "c", "y"), (3, "d", "z")], "k int, name string, v string")
    got = {r.k: (r.name, r.v, r.merge_action) for r in triples.upsert(old, new, ["k"], ["name"]).collect()}
    assert got == {1: ("a", "x", "kept"), 2: ("b", "y", "matched"), 3: ("d", "z", "created")}
    empty = spark.createDataFrame([], "probe int, answer string")
    second = spark.createDataFrame([(1, "s")], "probe int, answer string")
    assert [r.priority for r in triples.first_answering([empty, second]).collect()] == [1]


def test_pages(spark):
    from factloom.operators import pages

    body = "Mars is red. " * 12
    html = f"""<html><head><title>x</title><script>no()</script></head><body><h1>Mars</h1><table class="infobox"><tr><th>Mass (kg)</th><td>6.4171e23 kg<sup>[1]</sup></td></tr>
<tr><th>Atmosphere</th><td>95% CO2, 3% N2</td></tr><tr><th>Empty</th><td></td></tr><tr><th>Other</th><td><table><tr><td>in</td><td>ner</td></tr></table></td></tr></table>
<table class="infobox"><tr><th>Mass</th><td>second box</td></tr></table><p>{body}</p><h2>Orbit</h2><p>Short.</p><div class="navbox">links</div><h3>Deep</h3>{body}<h2>References</h2>gone"""
    df = spark.createDataFrame([("Mars", html), ("None", None), ("Empty", "")], "title string, html string")
    parsed = pages.parse(df, "title", "html")
    sections = [(r.path, r.content) for r in pages.section_rows(parsed, "title").orderBy("section_no").collect() if r.path]
    assert [s[0] for s in sections] == ["Mars", "Mars > Orbit", "Mars > Orbit > Deep"] and "links" not in str(sections) and "gone" not in str(sections)
    facts = [(r.subject, r.relation, r.object) for r in pages.infobox_facts(parsed, "title").collect()]
    assert facts == [("Mars", "HAS_MASS", "6.4171e23 kg"), ("Mars", "HAS_ATMOSPHERE", "CO2"), ("Mars", "HAS_ATMOSPHERE", "N2")]
    assert [(r.path, r.chunk_index) for r in pages.chunk_rows(parsed, "title").orderBy("section_no").collect()] == [("Mars", 0), ("Mars > Orbit > Deep", 0)]
    sheet = "<table><tr><td>Mass (10^24 kg)</td><td>0.64171</td></tr><tr><td>Volumetric mean radius (km)</td><td>3389.5</td></tr><tr><td>Atmosphere</td><td>CO2, N2</td></tr><tr><td>Distance from Sun (10^6 km)</td><td>228</td></tr></table>"
    got = {(r.relation, r.value, r.derived) for r in pages.fact_sheet(spark.createDataFrame([("m", sheet), ("n", None)], "k string, html string"), "k", "html").collect()}
    assert got == {("HAS_MASS", "0.64171e24 kg", False), ("HAS_RADIUS", "3389.5 km", False), ("HAS_ATMOSPHERE", "CO2, N2", False), ("ORBITS", "太阳", True)}
    raw = spark.createDataFrame([("p", "Phobos, a moon of Mars, orbits Mars. Its atmosphere has no argon and co2."), ("q", None)], "k string, t string")
    assert {(r.relation, r.object) for r in pages.raw_text_facts(raw, "k", "t").collect()} == {("HAS_ATMOSPHERE", "CO2"), ("HAS_ATMOSPHERE", "Ar"), ("ORBITS", "Mars"), ("PART_OF", "Mars system")}
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "stop"), ("a", 2, "y"), ("b", 0, "z")], "k string, i int, t string")
    assert sorted((r.k, r.i) for r in pages.keep_until(rows, "k", "i", F.col("t") == "stop").collect()) == [("a", 0), ("b", 0)]


def test_numbering_of_a_hot_key(spark):
    """Numbers within a key run on over the ranges that hold it; null keys are keys."""
    df = spark.range(2000).selectExpr("if(id % 10 = 0, null, 'hot') as k", "2000 - id as at").repartition(7)
    got = quality.numbered(df, ["k"], "at", "n").collect()
    for key in (None, "hot"):
        own = sorted((r["at"], r["n"]) for r in got if r["k"] == key)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert len(got) == 2000
