import math
import random
import zlib
from collections import Counter

import pytest
from factloom.llm import ctw


def corpus():
    rng = random.Random(9)
    parts = ["tha", "ing", " of", " ", "é", "ou", ". ", "THE", "\n"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([3, 20, 60])))) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, "unseen Zebra quartz!"), (3, docs[3][1]), (None, "null id")]


def held(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 5 == 1


@pytest.mark.parametrize("most, least", [(1 << 20, 1), (120, None)])
def test_scores_are_the_definition(spark, most, least):
    docs = corpus()
    train = spark.createDataFrame([d for d in docs if not held(d[0])], "doc_id long, text string")
    model = ctw.fit(train, depth=3, most=most)
    texts = [t or "" for d, t in docs if not held(d)]
    if least is None:  # the least power of two that keeps few enough pairs of each depth
        least = 1
        while True:
            seen, pairs = Counter(), {}
            for t in texts:
                data = bytes(3) + t.encode() + b"\xff"
                for i in range(3, len(data)):
                    for d in range(4):
                        seen[data[i - d : i]] += 1
                        pairs.setdefault(data[i - d : i], set()).add(data[i])
            if all(sum(len(pairs[s]) for s in pairs if len(s) == d and seen[s] >= least) <= most for d in range(4)):
                break
            least *= 2
        assert least > 1
    got = {(r.doc_id, r.text): r.score for r in ctw.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    want = ctw.brute_force_score(texts, [t or "" for _, t in docs], depth=3, least=least)
    for (doc, text), w in zip(docs, want, strict=True):
        assert got[doc, text] == pytest.approx(w, rel=1e-4, abs=1e-4)


def test_contract(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 400)
    docs = corpus()
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, block int").write.parquet(str(tmp_path / "documents.parquet"))
    rows = ctw.op2_ctw(spark, str(tmp_path)).collect()
    tokens = [[*(t or "").encode().translate(ctw.ops.LOWER_TABLE).split(), b""] for _, t in docs]
    seen = Counter(w for (d, _), t in zip(docs, tokens, strict=True) if not held(d) for w in t)
    n, v = sum(seen.values()), len(seen)
    want = [(d, held(d), len(t), sum(w in seen for w in t), n, round(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for (d, _), t in zip(docs, tokens, strict=True)]
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in rows) and len({r.score for r in rows if r.doc_id in (100, 101)}) == 1


def test_query_keeps_the_whole_tree(spark, tmp_path, monkeypatch):
    """However small the in-memory model may be, the query's scores are those of the tree with every context."""
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 400)
    monkeypatch.setattr(ctw, "BLOCKS_A_SALT", 4)
    monkeypatch.setattr(ctw, "AT_ONCE", 100)
    monkeypatch.setattr(ctw, "MODEL_GRAMS", 120)
    monkeypatch.setattr(ctw.fit, "__kwdefaults__", {**ctw.fit.__kwdefaults__, "most": 120})
    docs = corpus()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = ctw.brute_force_score([t or "" for d, t in docs if not held(d)], [t or "" for _, t in docs])
    got = {(r.doc_id, round(r.score, 4)): r for r in ctw.op2_ctw(spark, str(tmp_path)).collect()}
    for (doc, text), w in zip(docs, want, strict=True):
        near = [r for (d, _), r in got.items() if d == doc and r.score == pytest.approx(w, rel=1e-4, abs=1e-4)]
        assert near and near[0].bits_per_byte == pytest.approx(-w / math.log10(2) / (len((text or "").encode()) + 1), rel=1e-4)


def test_without_training_texts(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = ctw.score(df, ctw.fit(df.limit(0))).first()
    assert r.score == pytest.approx(24 * math.log10(0.5), rel=1e-5) and r.bits_per_byte == pytest.approx(8)
    assert ctw.score(df.limit(0), ctw.fit(df)).count() == 0


def test_log_gamma():
    import numpy as np

    x = np.array([0.5, 1, 1.5, 3.25, 7.9, 8, 50.5, 1e6, 3e9])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_many_tiny_and_equal_rows_fill_several_blocks(spark, tmp_path, monkeypatch):
    """Blocks are bounded by rows too, and equal rows don't share one."""
    monkeypatch.setattr(ctw, "BLOCK_ROWS", 100)
    spark.range(3000).selectExpr("1L as doc_id", "'same' as text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = ctw.op2_ctw(spark, str(tmp_path)).groupBy("n_tokens", "n_known", "train_tokens", "score").count().collect()
    assert [(r.n_tokens, r["count"]) for r in rows] == [(2, 3000)]
