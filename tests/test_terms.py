import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from factloom.functions import automaton, wordtable
from factloom.operators import retrieval, terms
from factloom.plans.catalogue import CATALOGUE


@pytest.mark.parametrize(("lane", "cells"), [(1, 1 << 25), (3, 0), (3, 1 << 25), (512, 0), (512, 1 << 25)])
def test_automaton_finds_every_occurrence(monkeypatch, lane, cells):
    monkeypatch.setattr(automaton, "LANE", lane)
    monkeypatch.setattr(automaton, "TABLE_CELLS", cells)
    r = random.Random(lane)
    for _ in range(60):
        words = sorted({"".join(r.choices("ab你😀", k=r.randrange(1, 6))) for _ in range(r.randrange(0, 15))})
        texts = [None if r.random() < 0.1 else "".join(r.choices("ab你😀 ", k=r.randrange(0, 40))) for _ in range(6)]
        found = automaton.Automaton(words).find_in(texts)
        want = sorted((i, k + len(w), j) for i, t in enumerate(texts) for j, w in enumerate(words) for k in range(len(t or "")) if (t or "").startswith(w, k))
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == want


@pytest.mark.parametrize("shard_signs", [1 << 20, 6])
def test_found_terms(spark, shard_signs):
    r = random.Random(5)
    words = sorted({"".join(r.choices("abc ", k=r.randrange(1, 5))) for _ in range(30)})
    rows = [(i, "".join(r.choices("abc d", k=r.randrange(0, 30)))) for i in range(80)] + [(80, None), (81, "")]
    dictionary = spark.createDataFrame([(w,) for w in [*words, words[0], "", None]], "term string")
    found = terms.found_terms(spark.createDataFrame(rows, "id int, text string"), ["id"], "text", dictionary, shard_signs=shard_signs).collect()
    assert {x.id: x.terms for x in found} == {i: [w for w in words if w in (t or "")] for i, t in rows}


def likelihood(words, counts, total):
    return sum(math.log(counts.get(w, 1) / total) for w in words)


def splits(run, counts):
    """All divisions of a run into known words and single signs."""
    for mask in itertools.product([False, True], repeat=max(len(run) - 1, 0)):
        cuts = [0, *(i + 1 for i, m in enumerate(mask) if m), len(run)]
        parts = [run[a:b] for a, b in itertools.pairwise(cuts)]
        if all(len(p) == 1 or p in counts for p in parts):
            yield parts


@pytest.mark.parametrize("shard_signs", [1 << 20, 5])
def test_division_is_the_best_of_all(spark, shard_signs):
    r = random.Random(9)
    counts = {"".join(r.choices("天地人", k=r.randrange(1, 5))): r.randrange(1, 50) for _ in range(25)}
    counts |= {"the": 9, "then": 4, "he": 7, "n": 2}
    total = sum(counts.values())
    texts = ["".join(r.choices("天地人心", k=r.randrange(0, 11))) for _ in range(40)]
    rows = [*enumerate(texts), (100, None), (101, "then 天,地! 心心")]
    known = spark.createDataFrame([*counts.items(), ("a b", 50), ("zero", 0)], "term string, n long")
    found = {x.id: x.words for x in terms.divided(spark.createDataFrame(rows, "id int, text string"), ["id"], "text", known, shard_signs=shard_signs).collect()}
    for i, t in enumerate(texts):
        assert "".join(found[i]) == t
        if t:
            best = max(likelihood(s, counts, total) for s in splits(t, counts))
            assert math.isclose(likelihood(found[i], counts, total), best)
    assert found[100] == []
    assert found[101][0] == "then" and "".join(found[101][1:]) == "天地心心" and found[101][-2:] == ["心", "心"]


def test_all_words_of_a_corpus_count(spark, tmp_path):
    """A word that is rarer than 100,000 others is a word."""
    name = lambda i: "".join(chr(97 + (i >> 4 * k) % 16) for k in range(5))
    rows = [(d, " ".join(name(i) for i in range(d * 500, d * 500 + 500)) * 2) for d in range(202)] + [(900, "qqx, yzzz qqx yzzz"), (901, "qxqxq"), (902, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.words for r in CATALOGUE["text_word_lattice"][0](spark, str(tmp_path)).where("doc_id >= 900").collect()}
    assert found == {900: "qqx yzzz qqx yzzz", 901: "qxqxq", 902: ""}


@pytest.mark.parametrize("shard_signs, table_words, chunk", [(1 << 22, 1 << 20, 1 << 20), (64 * 7, 1 << 20, 5), (0, 1 << 20, 4), (64 * 3, 9, 4), (0, 10, 10)])
def test_words_of_tables_divide_as_those_of_an_automaton(spark, monkeypatch, shard_signs, table_words, chunk):
    monkeypatch.setattr(terms, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(terms, "SLICE_SIGNS", 150)
    r = random.Random(4)
    counts = {"".join(r.choices("天地ab😀x", k=r.randrange(1, 6))): r.randrange(1, 40) for _ in range(40)} | {"ab" * 70: 3, "b" * 65: 2, "z": 1}
    counts = {w: n for w, n in counts.items() if w.isalnum()}
    texts = ["".join(r.choices("天地abx, c😀z", k=r.randrange(0, 60))) for _ in range(50)] + ["ab" * 140, "b" * 200, None, ""]
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "id int, text string").coalesce(2)
    known = spark.createDataFrame([*counts.items()], "term string, n long")
    got = terms.divided(df, ["id", "text"], "text", known, shard_signs=shard_signs, table_words=table_words).collect()
    by = automaton.Divider(automaton.Automaton([*counts]), np.log(np.array([*counts.values()], float)) - np.log(sum(counts.values())), -np.log(sum(counts.values())))
    want = [(i % 7, t, terms._divide(terms._Runs([t]), by, None, []).to_pylist()[0]) for i, t in enumerate(texts)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("bits, base", [(27, None), (3, None), (27, 1)])
def test_word_tables_find_every_word_and_nothing_else(monkeypatch, bits, base):
    """Also where bit tables let everything through, and where words share the first half of their hashes."""
    monkeypatch.setattr(wordtable, "TABLE_BITS", bits)
    if base:
        monkeypatch.setattr(wordtable, "_BASES", (base, wordtable._BASES[1]))
    r = random.Random(bits)
    words = sorted({"".join(r.choices("ab你😀", k=r.randrange(1, 6))) for _ in range(60)} | {"ab" * 40})
    table = wordtable.WordTable({len(w) for w in words}, ((words[i : i + 7], np.arange(i, min(i + 7, len(words)), dtype=float)) for i in range(0, len(words), 7)))
    assert sorted(map(chr, table.alone)) == [w for w in words if len(w) == 1]
    text = "".join(r.choices("ab你😀c", k=400)) + "ab" * 50
    start = np.array([0, 130, 131, 300])
    length = np.array([120, 1, 160, 200])
    end, size, gain = table.find(automaton.signs(text), start, length)
    want = [(k + len(w), len(w), j) for a, n in zip(start.tolist(), length.tolist(), strict=True) for j, w in enumerate(words) for k in range(a, a + n - len(w) + 1) if text.startswith(w, k)]
    assert sorted(zip(end.tolist(), size.tolist(), gain.tolist(), strict=True)) == sorted(want)
    assert (np.diff(size) <= 0).all()
    none = wordtable.WordTable([], [])
    assert [len(x) for x in none.find(automaton.signs("ab"), np.array([0]), np.array([2]))] == [0, 0, 0]


def test_unknown_letters_join(spark):
    known = spark.createDataFrame([("the", 50), ("q", 3)], "term string, n long")
    df = spark.createDataFrame([(1, "xyzthe12q7 the漢字")], "id int, text string")
    assert terms.divided(df, ["id"], "text", known).first().words == ["xyz", "the", "12", "q", "7", "the", "漢", "字"]


def test_ties_and_empty_dictionaries(spark):
    df = spark.createDataFrame([(1, "abab"), (2, "")], "id int, text string")
    none = spark.createDataFrame([], "term string, n long")
    assert {x.id: x.words for x in terms.divided(df, ["id"], "text", none).collect()} == {1: ["abab"], 2: []}
    run, end = automaton.best_paths(np.array([3]), np.zeros(5, int), np.array([1, 2, 2, 3, 3]), np.array([1, 2, 1, 2, 1]), np.array([-1.0, -2, -1, -2, -1]))
    assert run.tolist() == [0, 0] and end.tolist() == [1, 3]


def test_paths_through_words_within_words():
    """Rows that go on in other rows, and memory that doesn't follow all the words that could be taken."""
    words = ["a" * k for k in range(1, 101)] + ["ab", "b", "aab"]
    gain = -np.sqrt(np.arange(1, len(words) + 1)) - 1
    by = automaton.Divider(automaton.Automaton(words), gain, -9.0)
    texts = ["a" * 150, "aab" * 30 + "a" * 90, "", "caca", "b"]
    length = np.array([len(t) for t in texts])
    start = np.cumsum(length + 1) - length - 1
    found = by.paths(automaton.signs("-".join(texts)), start[length > 0], length[length > 0])
    taken = [[] for _ in texts]
    for r, e in zip(*found, strict=True):
        taken[np.flatnonzero(length > 0)[r]].append(int(e))
    of = dict(zip(words, gain, strict=True))
    for t, ends in zip(texts, taken, strict=True):
        best, back = [0.0], [0]
        for i in range(1, len(t) + 1):
            ways = [(best[i - k] + of.get(t[i - k : i], -9.0 if k == 1 else -np.inf), k) for k in range(min(i, 100), 0, -1)]
            top = max(w for w, _ in ways)
            best.append(top)
            back.append(next(k for w, k in ways if w == top))
        i, expected = len(t), []
        while i:
            expected.append(i)
            i -= back[i]
        assert ends == expected[::-1]
    long = automaton.signs("a" * 5_000)  # half a million words could be taken
    tracemalloc.start()
    by.paths(long, np.array([0]), np.array([len(long)]))
    assert tracemalloc.get_traced_memory()[1] < 5e6
    tracemalloc.stop()


def test_slices_hold_one_slice_of_texts():
    texts = [None, "", "é天😀" * 100_000, *("a" * 300_000 for _ in range(80)), None]
    batches = [pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts}), pa.RecordBatch.from_pydict({"id": [7], "text": ["x"]}), pa.RecordBatch.from_pydict({"id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})]
    seen = []
    tracemalloc.start()
    for batch, part in terms.slices(iter(batches), "text"):
        assert len(part) == batch.num_rows and (len(part) == 1 or sum(len(t or "") for t in part) <= terms.SLICE_SIGNS)
        seen += zip(batch.column("id").to_pylist(), [t and (len(t), t[:3]) for t in part], strict=True)
    assert tracemalloc.get_traced_memory()[1] < 9e6
    tracemalloc.stop()
    assert seen == [*((i, t and (len(t), t[:3])) for i, t in enumerate(texts)), (7, (1, "x"))]


def test_query_context(spark):
    rows = [(1, "太阳_为什么 发光"), (2, "Is the  RED planet bigger than venus express"), (3, None), (4, "由谁发现 它 火卫一的直径"), (5, "数据集中在外中")]
    asked = spark.createDataFrame(rows, "id int, q string")
    titles = spark.createDataFrame([("Venus",), ("Venus-Express",), ("火卫一",), ("Venus",), (" ",), (None,)], "term string")
    aliases = spark.createDataFrame([("red planet", "火星", 2), ("Planet", "planet", 1), ("sol", "太阳", 3)], "alias string, canonical string, ordinal int")
    found = {r.id: r for r in retrieval.query_context(asked, titles, "q", ["id"], aliases=aliases).collect()}
    assert found[2].entities == ["planet", "火星", "Venus-Express", "Venus"] and found[2].primary_entity == "planet"
    assert found[1].query == "太阳 为什么 发光" and found[1].topic_intents == ["solar_luminosity"] and found[1].topic_terms[:2] == ["核融合", "核心"]
    assert found[3].entities == [] and found[3].primary_entity == "" and found[3].topic_terms == [] and found[3].relation_hints == []
    assert found[4].entities == ["火卫一"] and found[4].topic_intents == ["diameter"] and found[4].relation_hints == ["DISCOVERED_BY", "HAS_RADIUS"] and "它" not in found[4].topic_terms
    assert found[5].relation_hints == []
