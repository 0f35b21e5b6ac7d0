import random

import pytest
from factloom.llm import langid as g

SYLLABLES = {"en": ["the", "ing", "and", "tion"], "de": ["sch", "ung", "ein", "über"], "fr": ["eau", "ment", "é", "oui"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(2)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    langs = list(SYLLABLES)
    docs = [(i, text(rng, langs[i % 3], 40), langs[i % 3]) for i in range(90)] + [(90, "no language", None), (91, None, "en"), (None, "", "de")]
    pages, truth = [], {}
    for i in range(80):
        lang = langs[i % 3] if i % 5 else "de"
        truth[i] = lang
        tag = lang if i % 4 else "en"
        host = rng.choice(["a.x.de", "b.x.de", "c.de"]) if lang == "de" else rng.choice(["www.y.com", "z.com", "q.org"])
        body = text(rng, lang, 30) if i % 7 else ""
        pages.append((i, f"http://{host}/{lang if i % 3 else 'page'}/{i}", f'<html lang="{tag}-x"><p>{body}'))
    pages += [(100, None, None), (None, "", ""), (3, pages[3][1], pages[3][2]), (3, pages[3][1], pages[3][2])]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    return frame, spark.createDataFrame(docs, "doc_id long, text string, lang string"), truth


def test_matches_brute_force(spark, tables):
    pages, docs, truth = tables
    model = g.train(*g.sample(docs, id_col="doc_id", text_col="text", lang_col="lang"))
    assert model[0] == ["de", "en", "fr"]
    found = g.evidence(pages, model, id_col="page_id", url_col="url", html_col="html")
    rows = [r.asDict() for r in found.collect()]
    want = sorted(((r["page_id"], lang, round(p, 9)) for r, (lang, p) in zip(rows, g.brute_force(rows, model[0]), strict=True)), key=str)
    got = g.identify(pages, docs).collect()
    assert sorted(((r.page_id, r.lang, round(r.confidence, 9)) for r in got), key=str) == want
    right = sum(r.lang == truth[r.page_id] for r in got if r.page_id in truth)
    assert right >= 0.95 * sum(r.page_id in truth for r in got)
    assert {r.host for r in got if r.page_id == 100} == {""}


def test_without_documents_or_pages(tables):
    pages, docs, _ = tables
    assert {r.lang for r in g.identify(pages, docs.limit(0)).collect()} == {None}
    assert g.identify(pages.limit(0), docs).count() == 0


def test_every_language_is_learned(spark):
    """More than 64 languages, one with long texts only, one with copies of a single row only."""
    rng = random.Random(7)
    own = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for i in range(68)}
    say = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    docs = [(i, say(lang, 40), lang) for i, lang in enumerate([*own] * 2) if lang not in ("l66", "l67")]
    docs += [(1000, say("l66", 12_000), "l66"), *[(1001, say("l67", 40), "l67")] * 900]
    pages = [(i, f"http://h{i}.x/", f"<p>{say(lang, 60)}") for i, lang in enumerate(own)]
    got = g.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string"), lang_col="lang").collect()
    assert {r.page_id: r.text_lang for r in got} == dict(enumerate(own))
    assert {r.page_id: r.lang for r in got} == dict(enumerate(own))
