import random
import time

from factloom.operators import markup

BODY = "正文" * 30


def build(r, depth):
    """(markup, plain text) of a random piece of nested markup."""
    pick = r.randrange(8 if depth else 3)
    if pick < 3:
        return (w := r.choice(["火星", " b ", "x=1", "\n", "c} ", " ]d", "e"])), w
    inside = [build(r, depth - 1) for _ in range(r.randrange(0, 4))]
    source, plain = "".join(s for s, _ in inside), "".join(p for _, p in inside)
    if pick == 3:
        return "{{t|" + source + "}} ", " "
    if pick == 4:
        return "[[" + source + "|label {{x}}]] ", plain + " "
    if pick == 5:
        return f"<ref name=a>{'z' * r.randrange(3)}</ref><b>" + source + "</b><ref/>", plain
    if pick == 6:
        return "<!-- {{ [[ -->" + source, plain
    return "{{a|k={{b|" + source + "}}|[[c]]}} " + source, " " + plain


def test_random_nesting():
    r = random.Random(3)
    for _ in range(2000):
        parts = [build(r, 4) for _ in range(r.randrange(1, 5))]
        assert markup._Reader("".join(s for s, _ in parts)).text == "".join(p for _, p in parts)


def test_infobox_values():
    source = "{{Infobox planet\n| 质量 = {{val|6.4|e=23}} 6.4e23 kg<ref>a|b</ref>\n| 轨道 = [[太阳|日]]和[[木星]]\n| 名称 = 不要\n| 空 =\n| 很长的键" + "长" * 20 + " = x\n| 图 = " + "y" * 200 + "\n| 半径 = 1\n2 km\n| 质量 = 7 kg\n}}\n首段。\n\n== 物理 =="
    box, text = markup.fields(source)
    assert box == [("质量", "7 kg"), ("轨道", "太阳和木星"), ("半径", "1\n2 km")]
    assert text == "首段。\n\n== 物理 =="
    assert markup.fields("== 物理 ==\n{{Infobox x|a=1}}")[0] == []
    assert markup.fields("{{other|{{Infobox x|a=1}}}}{{信息框|b=2}}{{Infobox|c=3}}")[0] == [("b", "2")]
    assert markup.fields("") == ([], "") and markup.fields("{{Infobox|a=1") == ([], "{{Infobox|a=1")


def test_signs_that_never_close():
    assert markup._Reader("a {{b [[c|d").text == "a {{b [[c|d"
    assert markup._Reader("[[a {{b]] c").text == "a {{b c"
    assert markup._Reader("}} ]] | <ref>x").text == "}} ]] | x"
    assert markup.fields("x[12] y [3.4][编辑]  z<!-- open")[1] == "x y z"


def test_sections():
    text = f"{BODY}\n\n历史\n\n{BODY}\n{BODY}\n\n短\n\n物理特征\n\n{BODY}\n\n参考来源\n\n{BODY}\n\n大气\n\n太短"
    assert [(t, k) for t, _, k in markup.sections(text)] == [("", "factual"), ("历史", "narrative"), ("物理特征", "factual"), ("参考来源", "discard")]
    assert markup.sections(text)[1][1] == f"{BODY}\n{BODY}\n短"
    assert markup.sections("") == []


def test_views(spark):
    rows = [("火星", "{{Infobox|质量=1 kg}}" + f"{BODY}\n\n历史\n\n{BODY}"), ("空", None)]
    pages = markup.parsed(spark.createDataFrame(rows, "title string, text string"), "text", ["title"])
    assert [tuple(r) for r in markup.infobox_facts(pages, "title").collect()] == [("火星", "拥有质量", "1 kg", "infobox", "质量: 1 kg", "火星")]
    assert [(r.section_no, r.kind) for r in markup.section_rows(pages, ["title"], ("narrative",)).collect()] == [(1, "narrative")]
    assert {tuple(r) for r in markup.section_stats(pages, ["title"]).collect()} == {("火星", 2, 1, 1, 0), ("空", 0, 0, 0, 0)}


def test_time_grows_with_length():
    for piece in ("{{a|", "[[", "<ref>", "{{x}}", "[[a|b]]", "}}", "{{[[", "<!--"):
        began = time.perf_counter()
        markup.fields(piece * 100_000)
        assert time.perf_counter() - began < 5, piece
