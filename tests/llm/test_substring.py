import random

import pytest
from factloom.llm import substring as s
from pyspark.sql import functions as F


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["é", "x y"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    line = text(36)
    docs = []
    for i in range(n):
        w = text(rng.choice([3, 34, 35, 80, 200]))
        if i % 3 == 0:
            w += line + text(rng.choice([0, 5, 50]))
        if i % 10 == 1:
            w = text(20) + ["same"] * 60
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    near = docs[3][1].split()
    near[len(near) // 2] = "changed"
    return docs + [(100, docs[5][1]), (5, docs[5][1]), (None, docs[6][1]), (101, None), (102, ""), (103, " \n"), (104, " ".join(near)), (3, " ".join(near))]


def digest(df):
    text = F.trim(F.regexp_replace(F.coalesce("kept", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", F.sha2(text.cast("binary"), 256)).collect()), key=str)


@pytest.mark.parametrize("how", ["plain", "heavy", "some heavy", "small bins", "long texts"])
def test_matches_brute_force(spark, monkeypatch, how):
    docs = corpus()
    if how == "heavy":  # all windows are dealt on their own
        monkeypatch.setattr(s, "HEAVY_BYTES", 1)
    if how == "small bins":  # packets merge and bins settle in many steps
        monkeypatch.setattr(s, "BIN_BYTES", 2000)
        monkeypatch.setattr(s, "FLUSH_BYTES", 1000)
    if how == "some heavy":  # some slots are dealt by longer runs, some of those window by window
        monkeypatch.setattr(s, "HEAVY_BYTES", 700)
    if how == "long texts":  # every text of some words is worked through in parts
        monkeypatch.setattr(s, "LONG_BYTES", 150)
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, k1 string").repartition(3)
    got = s.substring_dedup(df)
    assert got.columns == ["doc_id", "text", "k1", "n_words", "n_removed", "kept"]
    assert digest(got) == sorted(s.brute_force(docs), key=str)


def test_kept_text_of_clean_documents_is_unchanged(spark):
    df = spark.createDataFrame([(1, "a \n b"), (2, None)], "doc_id long, text string")
    assert [r.kept for r in s.substring_dedup(df).orderBy("doc_id").collect()] == ["a \n b", None]


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(s.ops, "sequence_hashes", lambda h, k: (h[: max(0, len(h) - k + 1)] & 3).astype("uint64"))
    words = [f"w{i}" for i in range(50)]
    a = [(b" ".join(w.encode() for w in words[i : i + 35]), 1, i, i, 0) for i in (0, 1, 2, 0, 1)]
    hit = sorted(s._doubled(a, 35))
    assert hit == [(0, 0, 0, 35), (0, 0, 0, 35), (1, 1, 0, 35), (1, 1, 0, 35)]


def test_empty_table(spark):
    assert s.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    import numpy as np
    from factloom.llm import textops as t

    data = np.frombuffer(b"some words in a row and some again in a row " * 30, np.uint8)
    w = t.Words(data, np.array([0, len(data)]), t.WORD_WS)
    whole = w.hashes()
    monkeypatch.setattr(t, "SLICE_BYTES", 50)
    assert np.array_equal(w.hashes(), whole)
    assert len(set(whole.tolist())) == len(set(data.tobytes().split()))


def test_heavy_slots_ship_few_bytes(spark, monkeypatch):
    """Where most slots are over the bound, packets of longer runs keep what is shipped under four times the text."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(400))) for i in range(200)]
    df = s._keyed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    size = sum(len(t) for _, t in docs)
    monkeypatch.setattr(s, "LEAST_SLOT_BITS", 8)
    monkeypatch.setattr(s, "HEAVY_BYTES", 1)
    monkeypatch.setattr(s, "HEAVY_TIMES", 1)
    packets, _ = s.shipped(df, "text")
    assert packets.agg(F.sum(F.octet_length("blob"))).first()[0] < 4 * size


def test_a_very_long_text(spark):
    """A text of many parts loses what it repeats, across the parts' borders too."""
    rng = random.Random(3)
    line = [f"l{i}" for i in range(40)]
    words = [f"{rng.getrandbits(40):x}" for _ in range(1_200_000)]
    for at in (5, 700_000, 900_000):
        words[at : at + 40] = line
    row = s.substring_dedup(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    kept = [w for i, w in enumerate(words) if not any(at <= i < at + 40 for at in (5, 700_000, 900_000))]
    assert (row.n_words, row.n_removed) == (len(words), 120) and row.kept.split() == kept
