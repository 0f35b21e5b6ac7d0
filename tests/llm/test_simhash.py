import random

import numpy as np
from factloom.llm import simhash as s


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([40, 120, 300]))]
        docs.append((i, " ".join(words)))
        for j in range(rng.choice([0, 0, 2])):
            near = list(words)
            near[rng.randrange(len(near))] = "Changed"
            docs.append((1000 + 10 * i + j, "\n".join(near)))
    return docs + [(500, None), (501, ""), (502, " \t"), (503, "one"), (504, "One two"), (3, docs[0][1]), (None, docs[0][1]), (None, "alone with null id")]


def test_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fp string")
    got = sorted(map(tuple, s.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    want = sorted(s.brute_force(docs), key=str)
    assert got == want
    kept = s.keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == len({(c, f if c is None else 0) for _, f, c in want})


def test_empty_table(spark):
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_join_finds_all_links(monkeypatch):
    monkeypatch.setattr(s, "_FRONTIER", 500)
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30, 2), dtype=np.uint64)
    v = np.unique(np.bitwise_xor.reduce(flips, axis=2) ^ seeds[:, None])
    rng.shuffle(v)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3

    def roots(pairs):
        g = s._Groups(len(v))
        at = {int(x): i for i, x in enumerate(v)}
        for x, y in pairs:
            g.link(np.array([at[int(x)]]), np.array([at[int(y)]]))
        return g.root.tolist()

    want = roots([(v[i], v[j]) for i, j in np.argwhere(near) if i < j])
    assert roots(zip(*s.trie_join(np.sort(v), None, 3), strict=True)) == want
    x, y = np.sort(v[:500]), np.sort(v[500:])
    parts = [*zip(*s.trie_join(x, y, 3), strict=True), *zip(*s.trie_join(x, None, 3), strict=True), *zip(*s.trie_join(y, None, 3), strict=True)]
    assert roots(parts) == want


def test_blocks_are_trie_nodes():
    v = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 1000, dtype=np.uint64))
    parts = s._split(v, 50, 4)
    assert np.array_equal(np.concatenate(parts), v) and max(map(len, parts)) <= 50


def test_links_over_many_blocks(spark, monkeypatch):
    """Small blocks, and a third of the fingerprints alike in their first part."""
    monkeypatch.setattr(s, "BLOCK", 4)
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    seeds[:10] &= np.uint64((1 << 48) - 1)
    flips = np.uint64(1) << rng.integers(0, 64, (30, 12, 2), dtype=np.uint64)
    v = np.unique(np.bitwise_xor.reduce(flips, axis=2) ^ seeds[:, None])
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    got = {r.node: r.root for r in s.components(s._links(df, len(v), 3)).collect()}
    root = np.arange(len(v))
    near = np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3)
    for _ in range(len(v)):
        was = root.copy()
        np.minimum.at(root, near[:, 0], was[near[:, 1]])
        if np.array_equal(root, was):
            break
    signed = v.view(np.int64)
    groups = lambda key: sorted(sorted(int(x) for x in signed if key(int(x)) == k) for k in {key(int(x)) for x in signed})
    place = {int(x): i for i, x in enumerate(signed)}
    assert groups(lambda x: got.get(x, x)) == groups(lambda x: int(signed[root[place[x]]]))
