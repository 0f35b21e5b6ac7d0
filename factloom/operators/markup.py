"""Wiki markup: infobox values, plain text and sections of pages, by one pass with a stack of open brackets.

A text is read token by token. ``{{`` opens a template, ``[[`` a link; what closes them closes the innermost one of its kind,
and a bar divides the innermost. A template comes to nothing in plain text, a link to its target. What never closes stands for itself.
The first infobox in front of the first heading keeps its values. Nesting may be of any depth; time grows with the text's length.

Parsing runs in Arrow batches, a page at a time; facts and views of sections are relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom import dims
from factloom.operators import terms

FIELDS = "infobox array<struct<key:string,value:string>>, sections array<struct<title:string,text:string,kind:string>>, full_text string"
_TOKEN = re.compile(r"(\{\{)|(\}\})|(\[\[)|(\]\])|(\|)|(<!--)|<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>|(?m:^(={2,}))")
#: Elements whose content goes with them.
_GONE = ("ref", "gallery", "nowiki", "math")
_CLOSING = {name: re.compile(f"</{name}\\s*>", re.IGNORECASE) for name in _GONE}


@dataclass
class _Open:
    """An open template or link: the parts between its bars, and the equals sign that divides a part (its place in the part's pieces)."""

    sign: str
    parts: list[list] = field(default_factory=lambda: [[]])

    def text(self) -> list:
        """What stands there if it never closes."""
        out: list = [self.sign]
        for i, part in enumerate(self.parts):
            out += ["|"] * bool(i) + [part]
        return out


def _plain(pieces: list) -> str:
    """The strings of lists within lists of any depth, joined; lists are never copied into one another before."""
    out, rest = [], [iter(pieces)]
    while rest:
        for piece in rest[-1]:
            if isinstance(piece, str):
                out.append(piece)
            else:
                rest.append(iter(piece))
                break
        else:
            rest.pop()
    return "".join(out)


class _Reader:
    """Reads one text; ``text`` is it without templates and tags, ``boxes`` the infobox's parts."""

    def __init__(self, source: str):
        self.out: list = []
        self.open: list[_Open] = []
        self.count = {"{{": 0, "[[": 0}
        self.box: list[str] | None = None
        self.headed = False
        #: Where no element of a kind closes any more.
        self.unclosed: dict[str, bool] = {}
        at = 0
        while (found := _TOKEN.search(source, at)) is not None:
            self._put(source[at : found.start()])
            at = self._token(source, found)
        self._put(source[at:])
        while self.open:
            last = self.open.pop()
            self.count[last.sign] -= 1
            self._put(last.text())
        self.text = _plain(self.out)

    def _put(self, piece: str | list) -> None:
        if piece:
            (self.open[-1].parts[-1] if self.open else self.out).append(piece)

    def _token(self, source: str, found: re.Match) -> int:
        sign = found[0]
        if found[1] or found[3]:
            self.open.append(_Open(sign))
            self.count[sign] += 1
        elif found[2] or found[4]:
            self._close("{{" if found[2] else "[[", sign)
        elif found[5]:
            if self.open:
                self.open[-1].parts.append([])
            else:
                self._put(sign)
        elif found[6]:
            end = source.find("-->", found.end())
            return len(source) if end < 0 else end + 3
        elif found[8]:
            return self._tag(source, found)
        else:
            self.headed |= not self.open
            self._put(sign)
        return found.end()

    def _tag(self, source: str, found: re.Match) -> int:
        """The tag goes, and with an element of ``_GONE`` its content, if it closes."""
        name = found[8].lower()
        if name in _CLOSING and not found[7] and not found[9].rstrip().endswith("/") and name not in self.unclosed:
            end = _CLOSING[name].search(source, found.end())
            if end is not None:
                return end.end()
            self.unclosed[name] = True
        return found.end()

    def _close(self, opening: str, sign: str) -> None:
        if not self.count[opening]:
            self._put(sign)
            return
        while (last := self.open.pop()).sign != opening:  # opened within, never closed
            self.count[last.sign] -= 1
            self._put(last.text())
        self.count[opening] -= 1
        if opening == "[[":
            self._put(last.parts[0])
        elif self.box is None and not self.headed and not self.open and _plain(last.parts[0]).strip().lower().startswith(dims.INFOBOX_NAMES):
            self.box = [_plain(p) for p in last.parts[1:]]


def fields(source: str) -> tuple[list[tuple[str, str]], str]:
    """(infobox keys and values in their order, plain text)."""
    read = _Reader(source)
    box: dict[str, str] = {}
    for part in read.box or []:
        key, divided, value = (x.strip() for x in part.partition("="))
        if divided and key and value and len(key) <= dims.LONGEST_KEY and len(value) < dims.LONGEST_VALUE and key not in dims.SKIPPED_KEYS:
            box[key] = value
    text = re.sub(r"\[(?:\d+(?:\.\d+)?|编辑)\]", "", read.text)
    return list(box.items()), re.sub(" {2,}", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


def kind(title: str) -> str:
    """What a section is, by its title: discard before narrative, factual otherwise."""
    return next((name for name, words in dims.SECTION_KINDS if any(w in title for w in words)), "factual")


def sections(text: str) -> list[tuple[str, str, str]]:
    """(title, text, kind): short paragraphs that name a topic begin a section; sections under 50 signs are dropped."""
    out, title, body = [], "", []
    words = {w for _, listed in dims.SECTION_KINDS for w in listed} | {*dims.FACTUAL_TITLES, *dims.OTHER_TITLES}

    def close() -> None:
        whole = "\n".join(body)
        if len(whole) >= dims.SHORTEST_SECTION:
            out.append((title, whole, kind(title)))

    for part in (p.strip() for p in re.split(r"\n{2,}", text)):
        if part and len(part) <= dims.LONGEST_TITLE and any(w in part for w in words):
            close()
            title, body = part[:30], []
        elif part:
            body.append(part)
    close()
    return out


def parsed(pages: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` with infobox, sections and full_text of each page; a null text counts as empty."""
    own = T._parse_datatype_string(FIELDS)
    schema = T.StructType([*(pages.schema[k] for k in keep), *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(own)
        for batch, texts in terms.slices(batches, column):
            boxes, plain = zip(*(fields(t or "") for t in texts), strict=True)
            made = ([[{"key": k, "value": v} for k, v in b] for b in boxes], [[dict(zip(("title", "text", "kind"), s, strict=True)) for s in sections(p)] for p in plain], list(plain))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(m, f.type) for m, f in zip(made, kinds, strict=True))], names=[*keep, *own.fieldNames()])

    return pages.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)


def infobox_facts(pages: DataFrame, title: str, relation: Column | None = None) -> DataFrame:
    """(subject, relation, object, pattern, raw, source): every infobox value as a fact; relation: default the key behind a word for having."""
    rows = pages.select(F.col(title).alias("subject"), F.explode("infobox").alias("f"))
    key, value = F.col("f.key"), F.col("f.value")
    return rows.select("subject", (F.concat(F.lit(dims.HAS), key) if relation is None else relation).alias("relation"), value.alias("object"), F.lit("infobox").alias("pattern"), F.concat(key, F.lit(": "), value).alias("raw"), F.col("subject").alias("source"))


def section_rows(pages: DataFrame, keep: list[str], kinds: tuple[str, ...] = ("factual", "narrative")) -> DataFrame:
    """(keep, section_no, title, text, kind): the sections of some kinds, numbered within the page."""
    rows = pages.select(*keep, F.posexplode("sections").alias("section_no", "s"))
    return rows.where(F.col("s.kind").isin(*kinds)).select(*keep, "section_no", F.col("s.title").alias("title"), F.col("s.text").alias("text"), F.col("s.kind").alias("kind"))


def section_stats(pages: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, total_sections, factual_sections, narrative_sections, discard_sections)."""
    n = lambda name: F.size(F.filter("sections", lambda s: s["kind"] == name)).alias(f"{name}_sections")
    return pages.select(*keep, F.size("sections").alias("total_sections"), *map(n, ("factual", "narrative", "discard")))
