import random

from factloom.operators import fusion
from pyspark.sql import functions as F


def test_fused_table_reads_records_once_for_their_groups(spark, tmp_path):
    """The same rows as by way of all fused records; those of agreeing groups meet nothing."""
    r = random.Random(2)
    rows = [(r.choice(["a", "b", "c", None, " "]) if i < 20 else f"s{r.randrange(60)}", r.choice(["R", "S"]), str(r.choice([5, 5, 5, 6, 60])), r.choice(["x", "y", " "]), r.choice(["unknown", "mean", "equatorial"]) if i % 3 == 0 else "unknown", i) for i in range(300)]
    spark.createDataFrame(rows, "subject string, relation string, object string, source_name string, kind string, ordinal long").write.parquet(str(tmp_path / "t"))
    records = spark.read.parquet(str(tmp_path / "t"))
    value = F.struct(F.col("object").alias("normalized_value"), F.lit("u").alias("normalized_unit"), F.col("object").cast("double").alias("numeric_value"))
    options = {"value": value, "kind": F.col("kind"), "thresholds": {}, "near_default": 0.25}
    columns = ["subject", "relation", "object", "source_name", "ordinal"]
    table = fusion.fused_table(records, columns, **options)
    assert table._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    got = sorted(tuple(x) for x in table.collect())
    assert got == sorted(tuple(x) for x in fusion.fused_records(fusion.fuse(records, **options)).select(*columns, "fusion_status").collect())
    # By hand: a group's kinds, values and first record.
    groups = {}
    for s, rel, obj, _, kind, i in rows:
        if s and s.strip():
            groups.setdefault((s, rel), []).append((i, obj, kind))
    want = []
    for key, own in groups.items():
        if len(own) > 1 and len({o for _, o, _ in own}) == 1:
            want.append((*key, min(own)[0], "multi_source_agreement"))
            continue
        values = [float(o) for _, o, _ in own]
        status = "same_quantity_different_measurement_kind" if len({k for *_, k in own} - {"unknown"}) > 1 else "single_source_only" if len(own) == 1 else "near_equivalent_values" if (max(values) - min(values)) / max(values) <= 0.25 else "human_review_required"
        want += [(*key, i, status) for i, *_ in own]
    assert sorted((s, rel, i, status) for s, rel, _, _, i, status in got) == sorted(want)
    assert {w[-1] for w in want} >= {"multi_source_agreement", "same_quantity_different_measurement_kind", "near_equivalent_values", "human_review_required"}
