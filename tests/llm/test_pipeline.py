import random

import corpus_pipeline as c
import pytest
from factloom.llm import decontaminate, packing, simhash, substring, toxicity

BAD = ["scumbag", "idiotic"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeiounstrl") for _ in range(rng.choice([2, 4, 7]))) for _ in range(400)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    item, line = words(40), words(50)
    docs = []
    for i in range(240):
        w = words(rng.choice([30, 90, 150]))
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(BAD)
        if i % 7 == 0:
            w += line
        if i % 11 == 0:
            w += item
        docs.append((i, " ".join(w), "en", "s", 0, "x"))
        if i % 13 == 0:
            docs.append((500 + i, " ".join(w), "en", None, None, "y"))
    docs += [(900, None, None, None, None, None), (901, "", "en", "s", 0, "z"), (None, "words without an id here", "en", "s", 24, "z"), docs[4], docs[4]]
    top = str(tmp_path_factory.mktemp("tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(docs, schema).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    at = rows(docs)

    docs = c.drop_toxic(spark, docs, folder)
    kept = rows(docs)
    scores = toxicity.score_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert docs.columns == columns and kept == rows(scores.where("score < 0.7"))
    toxic = lambda t: any(w in BAD for w in (t or "").split())
    assert sum(toxic(t) for _, t in kept) < 0.15 * sum(toxic(t) for _, t in at)
    at = kept

    docs = c.drop_near_duplicates(spark, docs.checkpoint(), folder)
    kept, classes = rows(docs), {}
    for (doc, fp, least), (_, text) in zip(simhash.brute_force(at), at, strict=True):
        if doc == least:
            classes.setdefault((least, fp if doc is None else 0), []).append((doc, text))
    assert docs.columns == columns and len(kept) == len(classes) and all(any(k in v for v in classes.values()) for k in kept)
    at = kept

    docs = c.cut_repeats(spark, docs.checkpoint(), folder)
    kept = rows(docs)
    want = {(d, s) for d, _, _, s in substring.brute_force(at)}
    import hashlib

    assert docs.columns == columns and len(kept) == len(at)
    assert {(d, hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest()) for d, t in kept} == want
    assert all(r.n_chars == len(r.text) for r in docs.where("n_chars is not null and n_chars <> 0 and text is not null").collect())
    at = kept

    docs = c.drop_contaminated(spark, docs.checkpoint(), folder)
    kept = rows(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert docs.columns == columns and kept == [d for d in at if not decontaminate.brute_force([d], items)[d[0]][4]]

    got = c.pack(spark, docs.checkpoint(), folder).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    want = packing.brute_force_pieces(kept, lambda t: own.encode(t, add_special_tokens=False).ids)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)


def test_run(spark, folder):
    assert c.run(spark, folder).count() > 50
