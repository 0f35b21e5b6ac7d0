"""Facts from sentences by templates: all templates of a set in one scan of the sentences.

A template is written as the sentence it fits, with slots and choices::

    {s}{的|}{平均|赤道|}半径{为|约为|}{o:length}

``{s}`` is the subject, ``{o}`` or ``{o:kind}`` the object (kinds: ``KINDS``), ``{a|b|}`` one of the words (or nothing), ``{...}`` a gap; all else stands
for itself. A template becomes one regular expression, and the words of which a sentence must have one before it is tried (its cue). Templates
apply in their order, and each match is one candidate, so that "first" means: sentence, template, place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import dims
from factloom.functions import text
from factloom.operators import extraction, triples

_NAME, _BARE = r"[\p{L}\p{N}·-]", r"[\p{L}\p{N}·\-&&[^的]]"  # signs of a name, and of one that belongs to nothing
_NUMBER = r"\d[\d,]*(?:\.\d+)?(?:\s*[×xX]\s*10\^?[+-]?\d+|[eE][+-]?\d+)?"
_ONE_OF = lambda words: "(?:" + "|".join(map(re.escape, words)) + ")"
#: What fills a slot: a pattern, and whether it should be as short as the words behind it allow.
KINDS = {
    "": (r"[^。；;，,]{2,80}", True),
    "name": (_NAME + "{2,30}", True),
    "word": (r"[A-Za-z]{2,20}", False),
    "person": (r"[\p{L}][\p{L}·. ]{1,30}", True),
    "type": (_BARE + "{0,28}?" + _ONE_OF(dims.TYPE_WORDS), False),
    "group": (_BARE + "{1,28}?" + _ONE_OF((*dims.PART_ENDINGS, *dims.PLACE_ENDINGS)), False),
    "place": (_BARE + "{1,28}?" + _ONE_OF(dims.PLACE_ENDINGS), False),
    "length": (_NUMBER + r"\s*" + _ONE_OF(("公里", "千米", *dims.VALID_LENGTH_UNITS)), False),
    "mass": (_NUMBER + r"\s*" + _ONE_OF(("千克", "公斤", "吨", "木星质量", *dims.VALID_MASS_UNITS)), False),
    "number": (_NUMBER, False),
    "count": (r"\d+", False),
    "year": (r"\d{3,4}", False),
    "heat": (r"[+-]?" + _NUMBER + r"\s*(?:°C|℃|K)", False),
}
_PART = re.compile(r"\{([^{}]*)\}|([^{}]+)")


@dataclass(frozen=True)
class Template:
    """relation and form; ``pattern``, the group of subject and object, and ``cue`` follow from the form."""

    relation: str
    form: str
    pattern: str = field(init=False)
    subject: int = field(init=False)
    object: int = field(init=False)
    cue: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        parts = [(slot, literal) for slot, literal in _PART.findall(self.form)]
        out, groups, cue = [], {}, ()
        for i, (slot, literal) in enumerate(parts):
            if literal:
                choices = (literal,)
            elif slot == "...":
                out.append("[^。；;]*?")
                continue
            elif slot.partition(":")[0] in ("s", "o"):
                role, _, kind = slot.partition(":")
                body, short = KINDS[kind or ("name" if role == "s" else "")]
                groups[role] = len(groups) + 1
                out.append(f"({body}{'?' if short and i + 1 < len(parts) else ''})")
                continue
            else:
                choices = tuple(slot.split("|"))
            out.append(_ONE_OF(choices) if len(choices) > 1 else re.escape(choices[0]))
            # The cue: of the words that a match must have one of, those whose shortest is longest.
            if min(map(len, choices)) > min(map(len, cue), default=0):
                cue = choices
        if set(groups) != {"s", "o"}:
            raise ValueError(f"a template needs {{s}} and {{o}}: {self.form}")
        for name, value in {"pattern": "".join(out), "subject": groups["s"], "object": groups["o"], "cue": cue}.items():
            object.__setattr__(self, name, value)


def _set(rows: Sequence[tuple[str, str]]) -> tuple[Template, ...]:
    return tuple(Template(*r) for r in rows)


#: For encyclopedia pages: the subject has to be the page's own.
PAGE = _set([
    ("HAS_RADIUS", "{s}{的|}{平均|赤道|}半径{约为|为|是|:|：|}{o:length}"), ("HAS_RADIUS", "{s}{的|}{平均|赤道|}半径{达到|达|有|约}{o:length}"), ("HAS_RADIUS", "半径{为|是|有}{o:length}的{s}"),
    ("HAS_MASS", "{s}{的|}{总|}质量{约为|为|是|:|：|}{o:mass}"), ("HAS_MASS", "{s}{的|}{总|}质量{达到|达|有|约}{o:mass}"), ("HAS_MASS", "质量{为|是|有}{o:mass}的{s}"),
    ("HAS_ATMOSPHERE", "{s}{的|}大气{层|}{主要|}{由|以}{o}{组成|构成|为主}"), ("HAS_ATMOSPHERE", "{s}{的|}大气{层|}{的|}成分{为|是|:|：}{o}"), ("HAS_ATMOSPHERE", "{s}{的|}大气{层|}{中|}{主要|}{含有|包含|包括}{o}"),
    ("ORBITS", "{s}{围绕|环绕|绕}{o:name}{公转|运行|旋转}"), ("ORBITS", "{s}是{o:name}的{天然|}卫星"),
    ("IS_A", "{s}是{一颗|一个|一种|}{o:type}"), ("IS_A", "{s}{属于|被分类为|归类为}{o:type}"),
    ("PART_OF", "{s}是{o:name}的{组成部分|一部分|成员}"), ("PART_OF", "{s}属于{o:group}"),
    ("LOCATED_IN", "{s}{位于|位在|处于|处在}{o:place}"),
    ("DISCOVERED_BY", "{s}{于|在}{...}{由|被}{o:person}{所|}发现"), ("DISCOVERED_BY", "{s}由{o:person}{于|在}{...}发现"), ("DISCOVERED_BY", "{s}由{o:person}发现"), ("DISCOVERED_BY", "{o:person}发现{了|}{s}"),
])

#: For any sentence: the older relations, each template's first match.
SENTENCE = _set([
    ("围绕", "{s}{围绕|环绕|绕着|绕}{o:name}{公转|运行}"), ("围绕", "{s}{围绕|环绕}{o:name}"), ("围绕", "{s}是{o:name}的{天然|}卫星"), ("围绕", "{s}在{o:name}轨道上"), ("围绕", "{s}沿{o:name}的轨道"),
    ("拥有轨道参数", "{s}{的|}{轨道|}半长轴{为|是|:|：|}{o:number}"), ("拥有轨道参数", "{s}{的|}{轨道|}离心率{为|是|:|：|}{o:number}"), ("拥有轨道参数", "{s}{的|}公转周期{为|是|:|：|}{o:number}"), ("拥有轨道参数", "{s}{的|}轨道倾角{为|是|:|：|}{o:number}"), ("拥有轨道参数", "{s}距离太阳{约|}{o:number}"),
    ("拥有环境特征", "{s}{的|}表面温度{为|是|达|:|：|}{o:heat}"), ("拥有环境特征", "{s}{的|}{大气|表面}{气压|压力}{为|是|:|：|}{o:number}"), ("拥有环境特征", "{s}{的|}{表面|}重力{加速度|}{为|是|:|：|}{o:number}"),
    ("属于行星类型", "{s}是{一颗|一个|}{o:type}"), ("属于行星类型", "{s}属于{o:type}"), ("属于行星类型", "{s}{被|}分类{为|成}{o:type}"),
    ("拥有物理参数", "{s}{的|}{平均|赤道|}直径{为|是|约|:|：|}{o:length}"), ("拥有物理参数", "{s}{的|}{平均|赤道|}半径{为|是|约|:|：|}{o:length}"), ("拥有物理参数", "{s}{的|}质量{为|是|约|:|：|}{o:mass}"), ("拥有物理参数", "{s}{的|}{平均|}密度{为|是|约|:|：|}{o:number}"),
    ("拥有卫星", "{s}{拥有|有|包含}{至少|}{o:count}{颗|个}{已知|天然|}卫星"), ("拥有卫星", "{s}的{天然|}卫星{包括|有}{o:name}"),
    ("被探测", "{s}{探测|飞越|观测}了{o:name}"), ("被探测", "{s}由{o:person}发现"), ("被探测", "{s}{于|在}{o:year}年{...}发现"),
    ("位于", "{s}{位于|位在|处于|处在}{o:name}"),
    ("大气成分", "{s}{的|}大气由{o}{组成|构成}"), ("大气成分", "{s}{的|}大气{中|主要}含有{o}"),
])


def _candidate(number: int, t: Template) -> Callable[[Column, Column], Column]:
    """What a template makes of a match and its place."""
    group = lambda m, n: F.regexp_extract(m, t.pattern, n)
    return lambda m, at: F.struct(F.lit(number).alias("rule"), at.alias("at"), F.lit(t.relation).alias("relation"), group(m, t.subject).alias("subject"), group(m, t.object).alias("object"), m.alias("raw"))


def _candidates(sentence: Column, templates: Sequence[Template], first: bool) -> Column:
    """array<struct<rule, at, relation, subject, object, raw>> in order; a template runs only where a sentence has its cue."""
    out = []
    for i, t in enumerate(templates):
        found = F.regexp_extract_all(sentence, F.lit(t.pattern), F.lit(0))
        found = F.when(text.contains_any(sentence, t.cue) if t.cue else F.lit(True), F.slice(found, 1, 1) if first else found).otherwise(F.array().cast("array<string>"))
        out.append(F.transform(found, _candidate(i, t)))
    return F.flatten(F.array(*out))


def matches(sentences: DataFrame, column: str, templates: Sequence[Template], *, keep: Sequence[str] = (), first: bool = False) -> DataFrame:
    """(keep, rule, at, relation, subject, object, raw): every match (or each template's first) in every sentence."""
    rows = sentences.where(F.col(column).isNotNull()).select(*keep, F.explode(_candidates(F.col(column), templates, first)).alias("_m"))
    return rows.select(*keep, *(F.col(f"_m.{c}").alias(c) for c in ("rule", "at", "relation", "subject", "object", "raw")))


def worth_reading(sentence: Column, cues: Sequence[str] = dims.RELATION_VERBS) -> Column:
    """Eight signs or more, and four Han signs or a word that tells a relation."""
    han = F.length(F.regexp_replace(sentence, r"[^\p{IsHan}]", ""))
    return (F.length(sentence) >= 8) & ((han >= 4) | text.contains_any(sentence, cues))


def _trimmed(c: Column, before: Sequence[str], after: Sequence[str]) -> Column:
    """Without signs at both ends, then without one of the words before and behind."""
    bare = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), F.lit("，。、；;：:（）()[]【】 "))
    drop = lambda x, words, form: F.regexp_replace(x, form.format(_ONE_OF(sorted(words, key=len, reverse=True))), "")
    return F.trim(drop(drop(bare, before, "^{}"), after, "{}$"))


def page_facts(sentences: DataFrame, title: str, column: str, order: str, *, templates: Sequence[Template] = PAGE) -> DataFrame:
    """(title, subject, relation, object, raw, rule, ordinal): facts about a page's own subject, each once, first wins.

    A match counts if its cleaned subject is the title and its object has 1 to 120 signs; gases of an atmosphere are facts of
    their own. ordinal is (sentence, template, place, part).
    """
    read = sentences.where(worth_reading(F.col(column)))
    found = matches(read, column, templates, keep=[title, order])
    name = _trimmed(F.col("subject"), dims.LEADS, dims.TAILS)
    what = _trimmed(F.col("object"), dims.OBJECT_LEADS, ())
    own = found.where(name == F.trim(F.col(title))).withColumns({"subject": F.trim(F.col(title)), "_whole": what}).where(F.length("_whole").between(1, 120))
    parts = F.when(F.col("relation") == "HAS_ATMOSPHERE", extraction.components(F.col("_whole"))).otherwise(F.array("_whole"))
    one = own.select(title, "subject", "relation", "raw", "rule", "at", order, F.posexplode(parts).alias("_part", "object"))
    facts = one.select(title, "subject", "relation", "object", "raw", "rule", F.struct(F.col(order).alias("sentence"), "rule", "at", F.col("_part").alias("part")).alias("ordinal"))
    return triples.first_of(facts, ["subject", "relation", "object"])


def sentence_facts(sentences: DataFrame, key: Sequence[str], column: str, *, templates: Sequence[Template] = SENTENCE, entities: str | None = None) -> DataFrame:
    """(key, rule, relation, subject, object, raw): each template's first match in a sentence, each fact of a sentence once.

    A subject has 2 to 20 signs, a letter among them and no mark, and is no function word; a sentence's known entities (an array
    column) excuse one that holds or is held by an entity. An object is as good a name, or a number with or without a unit.
    """
    keep = [*key, *([entities] if entities else [])]
    found = matches(sentences, column, templates, keep=keep, first=True)
    s, o = F.trim("subject"), F.trim("object")
    name = lambda c: F.length(c).between(2, 20) & F.rlike(c, F.lit(r"\p{L}")) & ~F.rlike(c, F.lit(r"[\p{Ps}\p{Pe}/\\<>。,，;；:：\t\n]")) & ~c.isin(*dims.QUESTION_STOP)
    known = F.exists(F.coalesce(F.col(entities), F.array().cast("array<string>")), lambda e: F.contains(s, e) | F.contains(e, s)) if entities else F.lit(False)
    number = F.rlike(o, F.lit(f"^[+-]?{_NUMBER}" + r"\s*[\p{L}°℃%/·]*$"))
    kept = found.where((F.length(s) >= 2) & (name(s) | known) & (name(o) | number)).select(*key, F.struct("rule", "at").alias("ordinal"), "relation", s.alias("subject"), o.alias("object"), "raw")
    return triples.first_of(kept, [*key, "subject", "relation", "object"]).select(*key, F.col("ordinal.rule").alias("rule"), "relation", "subject", "object", "raw")
