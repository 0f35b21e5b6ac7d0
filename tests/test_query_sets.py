import hashlib

from factloom.operators import query_sets
from pyspark.sql import functions as F


def plan_nodes(plan):
    """The nodes of an executed plan."""
    name = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [(name, plan), *(n for b in below for n in plan_nodes(b))]


def test_only_candidates_with_small_hashes_are_put_in_order(spark):
    quotas = {"a": 5, "b": 40, "rare": 3}
    kind = F.when(F.col("id") < 2, "rare").otherwise(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("none")), (F.col("id") % 3 + 1).cast("int")))
    asked = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, "s").alias("source_name"), kind.alias("kind"), F.sha2(F.col("id").cast("string"), 256).alias("id"))
    chosen = query_sets.query_set(asked, quotas)
    found = sorted((str(r.source_name), r.kind, r.place, r.id) for r in chosen.collect())
    groups = {}
    for i in range(30_000):
        groups.setdefault(("None" if i % 2 else "s", "rare" if i < 2 else ("a", "b", "none")[i % 3]), []).append(hashlib.sha256(str(i).encode()).hexdigest())
    least = {g: sorted(ids, key=lambda x: hashlib.md5(f"v2|{x}".encode()).hexdigest())[: quotas.get(g[1], 0)] for g, ids in groups.items()}
    assert found == sorted((*g, n + 1, x) for g, ids in least.items() for n, x in enumerate(ids))
    chosen = query_sets.query_set(asked, quotas)
    jdf = chosen._jdf.queryExecution()
    jdf.executedPlan().executeCollect()
    kept = [n.metrics().apply("numOutputRows").value() for name, n in plan_nodes(jdf.executedPlan()) if name == "BroadcastHashJoinExec"]
    assert kept and min(kept) < 1_000
