import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from factloom.llm import alignment
from tokenizers import Tokenizer

TEXTS = [
    "Plain words, and some more words.", None, "", "a", " leading and  double  spaces \n\n tabs\t\t", "<|endoftext|> is text, <s> too </s> <unk>", "日本語のテキスト 한국어 ünïcödé 😀😃 ‍﻿",
    "▁ the mark itself", "é ﬁ ½ Ⅷ", "a" * 5000 + " " * 4500 + "b", "\u0000\x01 control", "x\ry\r\nz", "don't can't we'll 1234567890 12.5e-3", "same words", "same words",
]


def tokens():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = alignment.PieceTokens(public_tokenizers.path("piece_bpe_32k.model"))
    spelling = alignment.ByteTokens(public_tokenizers.path("byte_bpe_50k.json")).tokens
    return a, b, spelling


def brute(rows):
    """By walking both sides' tokens, and counting all links in one dictionary."""
    a, b, spelling = tokens()
    docs = []
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.own.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(spelling[t] for t in ids_a) != whole or b"".join(b.tokens[t] for t in ids_b) != whole:
            docs.append((i, [], [], [], []))
            continue
        ends_a, ends_b = ([sum(map(len, side[:k + 1])) for k in range(len(side))] if len(side) < 200 else np.cumsum([len(x) for x in side]).tolist() for side in ([spelling[t] for t in ids_a], [b.tokens[t] for t in ids_b]))
        at_b = {e: j for j, e in enumerate(ends_b)}
        links = [(k, at_b[e]) for k, e in enumerate(ends_a) if e in at_b]
        groups, x, y = [], 0, 0
        for k, j in links:
            groups.append(",".join(map(str, ids_a[x : k + 1])) + "|" + ",".join(map(str, ids_b[y : j + 1])))
            x, y = k + 1, j + 1
        docs.append((i, ids_a, ids_b, groups, [(ids_a[k], ids_b[j]) for k, j in links]))
    count = Counter(p for d in docs for p in d[4])
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(i, len(x), len(y), len(g), len(p), sum(count[q] == most[q[1]] for q in p), sum(count[q] for q in p), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for i, x, y, g, p in docs]


@pytest.mark.parametrize("block", [1 << 21, 40])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    r = random.Random(1)
    alphabet = ["the ", "of", "ing", " ", "\n", "é", "漢", "😀", "1", "Z", ".", "aaa", "  ", "<s>", "\t"]
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(r.choices(alphabet, k=r.randrange(60)))) for i in range(150)] + [(None, "no id here")]
    df = spark.createDataFrame([(*row, "x", "y") for row in rows], "doc_id long, text string, block string, n_links string").repartition(3)
    assert sorted(map(tuple, alignment.align(df).collect()), key=str) == sorted(brute(rows), key=str)


def test_cuts_by_definition():
    r = np.random.default_rng(2)
    for density in (0.02, 0.3, 0.95):
        for _ in range(30):
            ends_a, ends_b, ptr, base = [], [], [0], 0
            for _ in range(int(r.integers(1, 6))):
                size = int(r.integers(0, 400))
                both = [np.flatnonzero(r.random(size) < density) + 1 + base for _ in range(2)]
                for ends, x in zip((ends_a, ends_b), both, strict=True):
                    ends += sorted({*x.tolist(), base + size} if size else set())
                base += size
                ptr.append(len(ends_a))
            cut = alignment.shared_cuts(np.array(ends_a, np.int64), np.array(ptr), np.array(ends_b, np.int64))
            assert np.flatnonzero(cut).tolist() == [i for i, e in enumerate(ends_a) if e in set(ends_b)]


def test_a_long_stretch_without_cuts_takes_little_time():
    n = 1_000_000
    ends = np.arange(1, n + 1) * 2
    other = np.append(ends[:-1] - 1, ends[-1])
    assert alignment.shared_cuts(ends, np.array([0, n]), other).sum() == 1
    other = np.unique(np.concatenate([other, ends[-40:]]))
    assert alignment.shared_cuts(ends, np.array([0, n]), other).sum() == 40
