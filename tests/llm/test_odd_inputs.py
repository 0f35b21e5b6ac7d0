"""Every query and stage on tables with nulls everywhere, very long texts, repeats, clashing columns; and on empty ones."""

import corpus_pipeline
import pytest
from factloom.llm import queries

CLASH = "score string, fp string, n_words string, kept string, label string, bin string, k1 string, spans string, piece string, length string, sequence_id string, media string, payload string, host string, own string, salt string, text_lang string, block string, word string, n_hit string, contaminated string, rank string, train string, held_out string, `_rest` string, `_rank` string, seq string, at string, kind string, key string, room string, row string, salts string, shard string, `_block` string"
N = CLASH.count("string")
VECTOR_CLASH = "id string, x string, v string, q string, own string, `at` string, mine string, score string, query_id string, copies string, component string, n string, deviation string, `rank` string"
_E = ("x",) * VECTOR_CLASH.count("string")
_NAN, _INF = float("nan"), float("inf")
#: 12 take part; (0, [1, 0]) stands there twice, the hot vector four times.
VECTORS = [
    (0, [1.0, 0.0], *_E), (0, [1.0, 0.0], *_E), (0, [0.5, 0.5], *_E), (100, [0.25, -0.5], *_E), (1, [1.0], *_E), (2, [], *_E), (3, [1e30, -1e30], *_E), (None, [1.0, 1.0], *_E),
    *[(7, [0.5, 0.5], *_E)] * 4, (200, None, *_E), (4, [1.0, None], *_E), (5, [_NAN, 1.0], *_E), (6, [1.0, _INF], *_E), (None, None, *_E),
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("odd"))
    extra = ("x",) * N
    none = (None,) * N
    words = " ".join(f"w{i % 977}" for i in range(400_000))
    docs = [
        (1, "plain words in a short text", "en", "s", 27, *extra), (2, words, "en", "s", 1, *extra), (3, "x" * 2_000_000, "de", None, None, *none), (4, None, None, None, None, *none),
        (5, "", "en", "s", 0, *extra), (6, " \t\n ", "en", "s", 4, *extra), (None, "a text without an id, a text without an id", "fr", "s", 9, *none), (None, None, None, None, None, *none),
        (7, "é\u0000ü \U0001f600   ..", "fr", "s", 3, *extra), (8, words, "en", "s", 1, *extra), (8, words[:4000], "en", "s", 1, *extra),
        *[(9, "the same row again and again", "en", "hot", 28, *extra)] * 40,
    ]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
    pages = [(1, "http://a.b/en/1", "<p>x" * 30_000, *extra), (1, None, None, *none), (None, "", "", *none), (2, "nonsense", "<table><tr><td>" * 2000, *extra), (2, "http://a.b/en/1", "<html lang=de><p>the same row again and again", *extra)]
    tables = {
        "documents": (docs, schema),
        "labels": ([(1, 1, 0), (2, 1, 1), (5, 0, 0), (9, 1, 0), (9, 0, 1), (None, None, None), (7, None, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, "plain words in a"), (None, "the same row again and again"), (2, None), (3, ""), (3, "row again")], "item_id long, text string"),
        "embeddings": (VECTORS, f"vec_id long, embedding array<float>, {VECTOR_CLASH}"),
        "pages": (pages, f"page_id long, url string, html string, {CLASH}"),
    }
    for name, (rows, ddl) in tables.items():
        df = spark.createDataFrame(rows, ddl)
        df.repartition(3).write.parquet(f"{top}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{top}/empty/{name}.parquet")
    return top, len(docs), len(pages)


@pytest.mark.parametrize("name", queries.queries())
def test_queries(spark, folders, name):
    top, n_docs, n_pages = folders
    f = queries.queries()[name]
    rows = f(spark, f"{top}/full").collect()
    if name.startswith("op11"):
        assert len(rows) == 4 * 10 and {r.query_id for r in rows} == {0, 100}
    elif name.startswith("op13"):
        assert len(rows) == 12 * 2 and {r.component for r in rows} == {1, 2}
    elif name.startswith("op5"):
        assert len({(r.doc_id, r.piece) for r in rows}) < len(rows) and sum(r.piece == 0 for r in rows) == n_docs
    else:
        assert len(rows) == (n_pages if name.startswith(("op3", "op4")) else n_docs)
    assert f(spark, f"{top}/empty").collect() == []


def test_pipeline(spark, folders):
    top, _, _ = folders
    docs = spark.read.parquet(f"{top}/full/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"{top}/full")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.schema == docs.schema
            docs = out.checkpoint()
    assert out.count() > 0
    assert corpus_pipeline.run(spark, f"{top}/empty").count() == 0
