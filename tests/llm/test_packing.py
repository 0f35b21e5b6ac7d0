import random

import numpy as np
from factloom.llm import packing as p
from tokenizers import Tokenizer

ODD = ["don't we'll  go\n\n now \t x", "  two  spaces ", "naïve çà 3²½ %%%###", "日本語 and ελληνικά", "a<|endoftext|>b", "x y\u0085z\x1cq", "", None, " ", "I'm 1234's 'tis"]


def corpus():
    rng = random.Random(7)
    vocab = ["the", "of", "thndhain", "Onhalyti", "été,", "x%%%", "12", "über"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 5, 20, 60, 200, 700]))) for _ in range(150)]
    return [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(ODD)), (3, texts[3]), (None, texts[4])]


def own(text):
    return Tokenizer.from_file(p.default_tokenizer()).encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    texts = [t for _, t in corpus()]
    tokens = p.Tokens.at(p.default_tokenizer())
    assert tokens.fast is not None
    texts += ["x" * 9000, "y" * 3999, " " * 9000 + "z", "\ud7ff\U0001f600 mixed"]
    got = [np.frombuffer(tokens.ids(t), "<u4").tolist() for t in texts]
    assert got == [own(t or "") for t in texts]


def test_packing(spark):
    docs, most = corpus(), 256
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int")
    rows = p.pack(df, max_tokens=most, with_ids=True).collect()
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    assert got == sorted(p.brute_force_pieces(docs, own, most), key=str)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= most
    # Best-fit decreasing, one piece at a time.
    gaps = []
    for n in sorted((r.length for r in rows), reverse=True):
        i = min((i for i, g in enumerate(gaps) if g >= n), key=lambda i: gaps[i], default=None)
        if i is None:
            gaps.append(most - n)
        else:
            gaps[i] -= n
    assert len(used) <= len(gaps) + 1
    whole = p.sequences(p.pack(df, max_tokens=most, with_ids=True)).collect()
    assert sorted(len(r.ids) // 4 for r in whole) == sorted(used.values())


def test_one_size_for_all_and_empty_table(spark):
    df = spark.createDataFrame([(i, "same words here") for i in range(500)], "doc_id long, text string")
    rows = p.pack(df, max_tokens=64).collect()
    n = rows[0].length
    assert len(rows) == 500 and len({r.sequence_id for r in rows}) == -(-500 // (64 // n))
    assert p.pack(df.limit(0)).count() == 0
