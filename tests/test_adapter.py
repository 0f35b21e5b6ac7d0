import json

import pytest
from factloom.sources import adapter
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    top, live = tmp_path_factory.mktemp("stored"), tmp_path_factory.mktemp("live")

    def put(base, source, name, payload):
        (base / source).mkdir(exist_ok=True)
        (base / source / f"{name}.json").write_text(payload if isinstance(payload, str) else json.dumps(payload))

    bundle = lambda title, obj: {"source_name": "x", "records": [{"title": title, "triples": [{"subject": title, "relation": "ORBITS", "object": obj}, {"subject": title, "relation": "IS_A", "object": 3}], "narratives": [{"section": "s", "content": f"about {title}"}]}]}
    put(top, "nasa", "mars", bundle("Mars", "Sun"))
    put(top, "nasa", "broken", "{")
    put(top, "esa", "juice", bundle("JUICE", "Jupiter"))
    amount = {"mainsnak": {"datavalue": {"value": {"amount": "+6.4", "unit": "http://x/entity/Q11570"}}}}
    put(top, "wikidata", "q111", {"entities": {"Q111": {"labels": {"en": {"value": "Mars"}}, "claims": {"P2067": [amount, {"mainsnak": {}}], "P9": [amount], "P397": [{"mainsnak": {"datavalue": {"value": {"id": "Q525"}}}}]}}, "Q2": {"claims": {"P397": [{"mainsnak": {"datavalue": {"value": "plain"}}}]}}}})
    put(live, "esa", "juice", bundle("JUICE", "Ganymede"))
    put(live, "nasa", "bad", "[1]")
    return str(top), str(live)


def load(spark, folders, **options):
    adapter.register(spark)
    props = json.dumps({"P2067": "HAS_MASS", "P397": "ORBITS"})
    return spark.read.format("facts").option("properties", props).option("live", folders[1]).options(**options).load(folders[0])


def test_bundles_and_claims(spark, folders):
    found = {(r.source_name, r.subject, r.relation, r.object) for r in load(spark, folders).collect()}
    assert found == {("nasa", "Mars", "ORBITS", "Sun"), ("nasa", "Mars", "IS_A", "3"), ("esa", "JUICE", "ORBITS", "Jupiter"), ("esa", "JUICE", "IS_A", "3"), ("wikidata", "Mars", "HAS_MASS", "6.4 Q11570"), ("wikidata", "Mars", "ORBITS", "Q525"), ("wikidata", "Q2", "ORBITS", "plain")}
    told = load(spark, folders, kind="narratives").collect()
    assert {(r.source_name, r.page_title, r.content) for r in told} == {("nasa", "Mars", "about Mars"), ("esa", "JUICE", "about JUICE")}


def test_modes(spark, folders):
    rows = load(spark, folders, mode="live").where("relation = 'ORBITS'").collect()
    assert {(r.source_name, r.object, r.fetched_by, r.used_fallback) for r in rows} == {("esa", "Ganymede", "live", False), ("nasa", "Sun", "offline", True), ("wikidata", "Q525", "offline", True), ("wikidata", "plain", "offline", True)}
    assert {r.fetched_by for r in load(spark, folders, mode="Dry-Run").collect()} == {"dry-run"}
    with pytest.raises(Exception, match="mode is one of"):
        load(spark, folders, mode="no").collect()


def test_sources_are_pruned(spark, folders):
    one = load(spark, folders).where("source_name = 'esa' and relation = 'ORBITS'")
    assert one.rdd.getNumPartitions() == 1 and [r.object for r in one.collect()] == ["Jupiter"]
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [EqualTo(source_name,esa)]" in plan
    assert load(spark, folders).where(F.col("source_name").isin("esa", "nasa")).rdd.getNumPartitions() == 3
    assert load(spark, folders).where("source_name = 'none'").collect() == []
