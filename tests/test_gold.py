from factloom.operators import gold

FACTS = "query_id int, expected array<struct<subject:string,relation:string,object:string>>, normalized_value string, expected_path array<string>, allowed array<string>, sources array<string>"
ROWS = "query_id int, rank int, path string, subject string, relation string, object string, source string, source_name string, source_role string, origin string, source_title string, schema_version string"
META = ("nasa", None, "r", "o", "t", "1")


def test_every_failure_of_fact_questions(spark):
    want = [("Mars", "ORBITS", "Sun")]
    mass = [("Mars", "HAS_MASS", "x")]
    questions = [
        (1, want, None, ["graph"], None, ["nasa"]), (2, want, None, ["graph"], None, None), (3, want, None, ["graph"], ["fallback", " "], None), (4, None, None, ["graph"], None, None), (5, [], None, ["graph", "none"], ["", "none"], None),
        (6, mass, "6.4 × 10", ["graph"], None, None), (7, mass, None, ["graph"], None, None), (8, want, None, ["graph"], None, ["esa"]), (9, want, None, ["graph"], None, None), (10, want, None, ["graph"], None, None), (11, want, None, [" graph "], None, None), (12, want, None, [""], None, None),
    ]
    results = [
        (1, 1, "graph", " Mars", "ORBITS", "Sun ", *META), (2, 1, "graph", "Mars", "ORBITS", "Jupiter", *META), (2, 2, "graph", "Mars", "ORBITS", "Sun", *META), (3, 1, "graph", "Mars", "ORBITS", "Sun", *META), (4, 1, "graph", "x", "y", "z", *META),
        (6, 1, "graph", "Mars", "HAS_MASS", "6.4x10", *META), (7, 1, "graph", "Mars", "HAS_MASS", "7", *META), (8, 1, "graph", "Mars", "ORBITS", "Sun", *META), (9, 1, "graph", "Mars", "ORBITS", "Sun", "nasa", "nasa", "", "o", "t", "1"), (10, 1, "inferred", "Mars", "ORBITS", "Sun", *META),
        (11, 1, "graph", "Mars", "IS_A", "planet", *META), (12, 1, "", "Venus", "IS_A", "planet", *META),
    ]
    got = {r.query_id: (r.failure, r.match_rank) for r in gold.structured(spark.createDataFrame(questions, FACTS), spark.createDataFrame(results, ROWS)).collect()}
    assert got == {1: ("pass", 1), 2: ("wrong ranking", 2), 3: ("path routing error", 1), 4: ("source leakage", None), 5: ("path routing error", None), 6: ("pass", 1), 7: ("wrong quantity", None), 8: ("source leakage", 1), 9: ("metadata contract break", 1), 10: ("inferred boundary break", 1), 11: ("wrong relation", None), 12: ("path routing error", None)}


def test_text_questions_and_overrides(spark):
    schema = "query_id int, expected array<struct<page_title:string,section_any_of:array<string>>>, expected_path array<string>, sources array<string>"
    rows = [(1, [("Mars", ["air"])], ["fallback"], None), (2, [("Mars", None)], ["fallback"], None), (3, [("Venus", [])], ["fallback"], None), (4, None, ["fallback"], None), (5, [("Mars", ["air"])], ["graph"], None)]
    questions = spark.createDataFrame(rows, schema)
    told = [(q, 1, "fallback", "Mars", "air" if q != 2 else "x", *META) for q in (1, 2, 3, 5)]
    results = spark.createDataFrame(told, ROWS.replace("subject string, relation string, object string", "page_title string, section string"))
    fixed = spark.createDataFrame([(5, ["fallback"])], "query_id int, expected_path array<string>")
    shaped = gold.overridden(questions, fixed, spark.createDataFrame([(4,)], "query_id int"))
    got = {r.query_id: r.failure for r in gold.narrative(shaped, results).collect()}
    assert got == {1: "pass", 2: "pass", 3: "wrong narrative hit", 5: "pass"}
    assert gold.narrative(questions, results.limit(0)).where("query_id = 4").first().failure == "path routing error"
