import os
import random
import time
from html import escape
from html.parser import HTMLParser

import pytest
from factloom.llm import html as h

CASES = [
    ("<p>a  b<p>c<br>d", "a b\n\nc\nd"),
    ("<title>x</title><h1>T</h1>one <b>two</b>&amp;three<script>var a='</p>';</script>", "T\n\none two&three"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>after", "- a\n- b\n  - c\n- d\n\nafter"),
    ("<ol start=3><li>a</li><li value=9>b</li><li>c</li></ol>", "3. a\n9. b\n10. c"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td colspan=2>wide</table>x", "name       n\nlong name  1\nwide\n\nx"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        b\n\nin  ner"),
    ("<pre> x\n  y</pre>z", " x\n  y\n\nz"),
    ("<div hidden>no</div><span style='color:red; display : none'>no</span><p style='display:block'>yes", "yes"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("plain < text & more", "plain < text & more"),
    ("<p>unclosed <b attr='x>y</p>", "unclosed y"),
    ("a<!-- c --><!doctype x>b<!-- open", "ab"),
    ("<noscript><p>no</p></noscript><template><p>t</template>v<textarea>\nk  l</textarea>", "v\nk  l"),
    ("</p></div>x</table><td>y", "xy"),
    ("<blockquote>q<p>r</blockquote><hr>s", "  q\n\n  r\n\ns"),
    ("<div>" * 5000 + "deep", "deep"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_layout(page, text):
    assert h.render(page) == text


FOREIGN = [
    ("a <svg><text>label</text><text>two</text></svg> b", "a label two b"),
    ("<p>x = <math><semantics><mrow><mi>y</mi><mo>+</mo><mn>1</mn></mrow><annotation encoding='tex'>y+1</annotation></semantics></math>.", "x = y+1."),
    ("<body><svg viewBox='0 0 1 1'/>rest<math/> of it", "rest of it"),
    ("<body><svg><path d='M0'/><use href=#a /><title/><style/><g><text/></g></svg>rest", "rest"),
    ("<svg><title>no</title><desc><p>no</p></desc><defs><text>no</text></defs><script>a&lt;b</script><style>c{}</style><text display=none>no</text><text>yes</text></svg>on", "yes on"),
    ("<svg width=1/><text>in</text></svg>out", "in out"),
    ("<div><svg><g><text>t</div>after", "t\nafter"),
    ("<svg><g><p>out</p></svg>on", "out\n\non"),
    ("<p>a<svg><foreignObject><p>b</p></foreignObject></svg>c", "a\n\nb\n\nc"),
    ("<svg><text><![CDATA[a < b &amp; c]]></text></svg>", "a < b &amp; c"),
    ("<math><mtext>if <b>n</b></mtext><annotation-xml encoding='text/html'><p>no</p></annotation-xml></math>z", "if nz"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes<i style='visibility:hidden'>no</i></b>no<br><q>no</q></div>on", "yes\non"),
    ("<p style='visibility:hidden'>no<input value=no><input value=yes style='visibility:visible'></p>on", "yes\n\non"),
]


@pytest.mark.parametrize("page, text", FOREIGN)
def test_svg_math_and_visibility(page, text):
    assert h.render(page) == text


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "script", "style", "title", "template") and 1
        self.out.append(" " if tag in h.BLOCK or tag == "br" else "")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style", "title", "template") and 1
        self.out.append(" " if tag in h.BLOCK else "")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_same_words_as_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in h.op3_html(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for r in pages:
        p = Plain()
        p.feed(r.html)
        words = [w.lstrip("-") for w in got[r.page_id].split()]
        assert [w for w in words if w] == [w for w in (x.lstrip("-") for x in "".join(p.out).split()) if w]


def test_declared_language_and_columns(spark):
    assert h.declared_language('<html class="x" lang="de-AT">') == "de" and h.declared_language("<p>") is None
    df = spark.createDataFrame([(1, "<p>x", "own"), (1, "<p>x", "own"), (None, None, None)], "page_id long, html string, text string")
    assert sorted(r.text for r in h.extract(df).collect()) == ["", "x", "x"]
    assert h.extract(df.limit(0)).count() == 0


# -- random trees, drawn by a definition of their own ------------------------------------------------------------------


class Tree:
    """A random page: its markup, with end tags left out where HTML implies them, and its text by recursion."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def words(self, least=0):
        return [self.rng.choice(["one", "two&", "<three", "é", "x"]) for _ in range(self.rng.randint(least, 4))]

    def inline(self, least=0):
        """Markup of some words, hidden parts between; and their text."""
        words = self.words(least)
        parts = []
        for w in words:
            tag = self.rng.choice(["b", "span", "a", None, None])
            parts.append(f"<{tag} class=c>{escape(w)}</{tag}>" if tag else escape(w))
            if self.rng.random() < 0.2:
                parts.append(self.rng.choice(["<script>no</script>", "<!-- no -->", "<i hidden>no<b>no</b></i>", "<span style='display:none'>no</span>"]))
        return self.rng.choice([" ", "\n  "]).join(parts), " ".join(words)

    def maybe(self, end):
        return end if self.rng.random() < 0.5 else ""

    def items(self, depth):
        """A list's markup and its lines."""
        kind, markup, lines = self.rng.choice(["ul", "ol"]), [], []
        for n in range(self.rng.randint(1, 3)):
            body, text = self.inline(1)
            own = [text]
            if depth < 3 and self.rng.random() < 0.4:
                inner, more = self.items(depth + 1)
                body, own = body + inner, own + more
            mark = f"{n + 1}. " if kind == "ol" else "- "
            lines += [(mark if not i else " " * len(mark)) + x for i, x in enumerate(own)]
            markup.append(f"<li>{body}{self.maybe('</li>')}")
        return f"<{kind}>{''.join(markup)}</{kind}>", lines

    def table(self):
        rows = [[self.inline() for _ in range(self.rng.randint(1, 3))] for _ in range(self.rng.randint(1, 3))]
        width = [max((len(row[i][1]) for row in rows if i < len(row)), default=0) for i in range(3)]
        lines = ["  ".join(text.ljust(w) for (_, text), w in zip(row, width, strict=False)).rstrip() for row in rows if any(text for _, text in row)]
        cells = ("".join(f"<td>{m}{self.maybe('</td>')}" for m, _ in row) for row in rows)
        return "<table>" + "".join(f"<tr>{c}{self.maybe('</tr>')}" for c in cells) + "</table>", lines

    def blocks(self, depth=0):
        """Markup, and (lines, whether a margin is around them) of each block."""
        markup, out = [], []
        for _ in range(self.rng.randint(1, 4)):
            kind = self.rng.choice(["p", "h2", "div", "nav", "list", "table", "pre", "gone"])
            if kind in ("p", "h2"):
                m, text = self.inline()
                markup.append(f"<{kind}>{m}{self.maybe('</p>') if kind == 'p' else '</h2>'}")
                out.append(([text] if text else [], True))
            elif kind in ("div", "nav"):
                inner, found = self.blocks(depth + 1) if depth < 4 else ("", [])
                markup.append(f"<{kind}>{inner}</{kind}>")
                out += [([], False), *found, ([], False)]
            elif kind in ("list", "table"):
                m, lines = self.items(0) if kind == "list" else self.table()
                markup.append(m)
                out.append((lines, True))
            elif kind == "pre":
                rows = [" " * self.rng.randint(0, 2) + " ".join(self.words(1)) for _ in range(2)]
                markup.append(f"<pre>{escape(chr(10).join(rows))}</pre>")
                out.append((rows, True))
            else:
                markup.append(f"<div style='display: none'>{self.table()[0]}<p>no</div>")
        return "".join(markup), out

    def page(self):
        markup, blocks = self.blocks()
        lines, gap = [], False
        for own, margin in blocks:
            gap |= margin and bool(lines)
            if own:
                lines += [""] * gap + own
                gap = margin
        while lines and not lines[-1]:
            lines.pop()
        return markup, "\n".join(lines)


def test_random_trees_are_drawn_as_defined():
    for seed in range(1500):
        markup, text = Tree(seed).page()
        assert h.render(markup) == text, (seed, markup)


def test_depth_and_width_cost_no_more_than_their_size():
    began = time.perf_counter()
    for page in ("<div>" * 20000 + "deep", "<p><button>" + "<div>" * 20000 + "deep" + "</div>" * 20000, "<ul><li>" * 20000 + "deep", "<b>" * 20000 + "<p>x" * 5000):
        assert h.render(page).strip(" -\n").startswith(("deep", "x"))
    assert time.perf_counter() - began < 8
    rows = "".join(f"<tr><td>{'x' * 5000 if i == 0 else 'y'}<td>z" for i in range(1000))
    drawn = h.render(f"<table>{rows}</table>")
    assert len(drawn) < 10 * len(rows) and drawn.count("z") == 1000
    assert len(h.render("<blockquote>x" * 3000)) < 300_000
    assert len(h.render("<table>" + "<tr><td colspan=1000>a<td>b" * 500 + "</table>")) < 500 * 600


def test_declared_language_takes_one_reading():
    import time

    for piece in ("<html ", "<meta ", "<html lang ", "<meta content-language ", "<!-- lang", "<script>lang", '<html lang="', "<html>lang ", "lang <meta content='' "):
        began = time.perf_counter()
        h.declared_language(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 1, piece
    assert h.declared_language("<!-- <html lang=fr> --><script>'<html lang=es>'</script><html lang=' DE_at'>") is None
    assert h.declared_language("<!-- <html lang=fr> --><script>'<html lang=es>'</script><html xml:lang='DE-at'>") == "de"
    assert h.declared_language("<meta content='pt-BR' http-equiv=Content-Language><html lang=en>") == "pt"
    assert h.declared_language("<html><p><html lang=it>") == "it" and h.declared_language("<html lang=''><meta http-equiv='content-language' content='nl'>") == "nl"
