from factloom.llm import decontaminate as d
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(60)]
ITEM = " ".join(WORDS[:20])
DOCS = [
    (1, "x y " + ITEM.upper() + " z"), (2, " ".join(WORDS[3:15])), (3, None), (4, ""), (5, "Só curto, só!"),
    (6, "filler " * 400 + ITEM), (6, ITEM), (7, "pre-" + ITEM.replace(" ", ", ")), (None, ITEM),
]
ITEMS = [(10, ITEM), (11, ITEM + " more"), (12, None), (13, "só CURTO"), (14, ""), (9, "absent words only here")]


def frames(spark):
    docs = spark.createDataFrame([(a, b, "k") for a, b in DOCS], "doc_id long, text string, n_words string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def digest(df):
    rows = df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated").collect()
    return sorted(map(tuple, rows), key=str)


def brute():
    out = []
    for doc in DOCS:
        out += [(k, *v) for k, v in d.brute_force([doc], ITEMS).items()]
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    docs, items = frames(spark)
    assert digest(d.decontaminate(docs, items)) == brute()


def test_blocks_give_the_same(spark):
    docs, items = frames(spark)
    assert digest(d.decontaminate(docs, items, max_words=20)) == brute()


def test_spans_are_removed(spark):
    docs, items = frames(spark)
    got = {r.doc_id: r.text for r in d.decontaminate(docs, items, remove_spans=True).collect()}
    assert got[1] == "x y  z" and got[5] == ", só!" and got[3] is None


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert d.decontaminate(docs.limit(0), items).count() == 0
    assert d.decontaminate(docs, items.limit(0)).where("n_hit > 0").count() == 0
