"""HTML to visible text with its layout.

A tokenizer and a tree builder with HTML's implied tags turn a page into open, text and close events; the
renderer draws them: blocks on lines of their own with a blank line where the page has a margin, list items
with bullets or numbers and indents, preformatted text as it is, table cells aligned in columns. Hidden
content (head, scripts, styles, templates, the hidden attribute, display:none, ...) is left out; visibility:hidden
hides up to a descendant that is visible again. Text of svg and math shows, without their titles, definitions and
annotations; their elements may close themselves, and text labels are kept apart by a blank. Nothing is recursive, and open elements are found by name, so deep nesting costs neither stack nor time. What layout adds is
bounded: cells pad others to at most ``WIDEST`` columns, a cell's room is at most ``MOST_ROOM``, and lines are indented by at most
``MOST_LEVELS`` levels. Pages are independent: one pass, no shuffle.

Defined results: null and empty pages give an empty text; text outside any tag is kept; an unclosed tag, comment
or script reaches to the end; repeated rows give equal texts; extra columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textops as ops

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none)\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|initial|hidden|collapse)\b", re.I)
#: An unquoted value up to the end of a start tag, whose last slash is its own.
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'>]+/\Z")
_BLANKS = re.compile(r"[ \t\n\r\f]+")

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title datalist audio video canvas object meta link".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript head html".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr form article section details".split())
BLOCK = MARGIN | frozenset("address aside body center dd dir div dt fieldset figcaption footer header html legend li main menu nav optgroup option search summary tbody td tfoot th thead tr caption textarea".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul".split())
#: For each start tag: the open elements it ends, and the elements that such a search doesn't leave.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
#: Elements of svg and math stand on the stack with a slash before their names; in these, markup is HTML again.
HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
FOREIGN_HIDDEN = frozenset("desc title defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter script style annotation annotation-xml mphantom".split())
FOREIGN_APART = frozenset("/text /mtd".split())
#: Start tags that end svg and math.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
BARRIER = frozenset("table td th caption button object html template".split()) | {"/" + tag for tag in HTML_AGAIN}


#: Columns of a table that a cell's length widens at most; columns of a cell at most; levels of indentation that are drawn.
WIDEST, MOST_ROOM, MOST_LEVELS = 120, 480, 32


class _Flow:
    """Lines of a block context (the page, or one table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0
        self.indent: list[str] = []
        self.mark = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            parts = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for i, part in enumerate(parts):
                if i:
                    self.line(True)
                if part:
                    self.inline.append(part)
        elif s:
            s = _BLANKS.sub(" ", s)
            if self.inline:
                if s[0] == " " and self.inline[-1].endswith(" "):
                    s = s[1:]
            else:
                s = s.lstrip(" ")
            if s:
                self.inline.append(s)

    def line(self, empty: bool = False) -> None:
        """End the line; an empty one counts only where the text says so (br, pre)."""
        s = "".join(self.inline).rstrip(" ")
        self.inline = []
        if not s and not empty:
            return
        self._put(s)

    def _put(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        levels = self.indent if len(self.indent) <= MOST_LEVELS else [*self.indent[: MOST_LEVELS - 1], self.indent[-1]]
        lead = "".join(levels)
        if self.mark:
            lead, self.mark = lead[: len(lead) - len(self.indent[-1])] + self.mark, ""
        self.lines.append((lead + s).rstrip(" "))

    def margin(self) -> None:
        self.line()
        if self.lines and not self.mark:
            self.gap = 1

    def block(self, lines: list[str]) -> None:
        self.line()
        for s in lines:
            self._put(s)

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int]]] = []
        self.caption: list[str] = []

    def drawn(self) -> list[str]:
        """Columns as wide as their widest cell (of those that span one column, WIDEST at most), two spaces apart."""
        width: list[int] = []
        for row in self.rows:
            at = 0
            for lines, span in row:
                width += [0] * (at + span - len(width))
                if span == 1:
                    width[at] = max(width[at], min(max(map(len, lines)), WIDEST)) if lines else width[at]
                at += span
        out = list(self.caption)
        for row in self.rows:
            for i in range(max((len(lines) for lines, _ in row), default=0)):
                at, parts = 0, []
                for lines, span in row:
                    room = min(sum(width[at : at + span]) + 2 * (span - 1), MOST_ROOM)
                    parts.append((lines[i] if i < len(lines) else "").ljust(room))
                    at += span
                out.append("  ".join(parts).rstrip(" "))
        return out


def _number(s: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", s or "")
    return int(m[1]) if m else default


def _self_closed(raw: str) -> bool:
    return raw.endswith("/") and not _UNQUOTED_END.search(raw)


class _Page:
    """Tree builder and renderer: a stack of open elements, each with what closing it must undo."""

    def __init__(self):
        self.flow = _Flow()
        self.stack: list[tuple[str, object]] = []
        #: Places on the stack of the open elements of each name.
        self.places: dict[str, list[int]] = {}
        self.tables: list[tuple[_Table, _Flow]] = []
        self.lists: list[list] = []
        self.hidden = 0
        self.pre = 0
        #: Of each open svg, math and HTML within them: whether its content is foreign; of each element that sets the visibility, its depth and what was before.
        self.foreign: list[bool] = []
        self.visibility: list[tuple[int, bool]] = []
        self.unseen = False

    def text(self, s: str) -> None:
        if self.hidden:
            if self.stack[-1][0] != "head" or not s.strip():
                return
            self.close("head")  # text ends an open head
        if self.unseen:
            return
        tag = self.stack[-1][0] if self.stack else ""
        if tag in ("table", "tr", "thead", "tbody", "tfoot", "colgroup"):
            if not s.strip():
                return
            # Stray text in a table stands before it.
            table, outer = self.tables[-1]
            outer.text(unescape(s) if "&" in s else s, False)
            outer.line()
            return
        self.flow.text(unescape(s) if "&" in s else s, bool(self.pre))

    def open(self, tag: str, raw: str) -> None:
        if tag not in HEAD_ONLY and self.hidden and self.stack[-1][0] == "head":
            self.close("head")
        if self.in_foreign:
            if tag not in ENDS_FOREIGN:
                self._open_foreign(tag, raw)
                return
            self._leave_foreign()
        elif tag in ("svg", "math"):
            self._open_foreign(tag, raw)
            return
        if tag in ("mglyph", "malignmark") and self.foreign:
            return
        if tag in CLOSES_P:
            self._end({"p"}, BARRIER)
        if tag in IMPLIED_END:
            self._end(*IMPLIED_END[tag])
            if not self.hidden and tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
                if not self.tables or not self.places.get("table"):
                    return  # no table to belong to: the tag is ignored, its content stays
                if tag in ("td", "th") and self.stack[-1][0] != "tr":
                    self.open("tr", "")
        elif tag in ("html", "body"):
            return
        if tag == "br":
            if not self.hidden and not self.unseen:
                self.flow.line(True)
            return
        if tag in VOID:
            if tag == "hr" and not self.hidden:
                self.flow.margin()
            elif tag == "input" and not self.hidden and raw:
                a = self._attributes(raw)
                if not self._unseen(a) and a.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and a.get("value"):
                    self.flow.text(" " + a["value"] + " ", False)
            return
        attributes = self._attributes(raw) if raw and not raw.isspace() else {}
        off = tag in HIDDEN or "hidden" in attributes or (tag == "dialog" and "open" not in attributes) or bool(_INVISIBLE.search(attributes.get("style", "")))
        if off or self.hidden:
            self.hidden += 1
            self._push(tag, "hidden")
            return
        undo: object = None
        self._see(attributes)
        if tag == "table":
            self.flow.line()
            self.tables.append((_Table(), self.flow))
        elif tag == "tr":
            self.tables[-1][0].rows.append([])
        elif tag in ("td", "th"):
            undo = min(max(1, _number(attributes.get("colspan"), 1)), 1000)
            self.flow = _Flow()
        elif tag == "caption" and self.tables:
            self.flow = _Flow()
        elif tag in BLOCK:
            self.flow.margin() if tag in MARGIN and not (tag in ("ul", "ol") and self.lists) else self.flow.line()
            if tag in ("ul", "ol", "menu", "dir"):
                self.lists.append([tag, _number(attributes.get("start"), 1)])
            elif tag == "li":
                mark = "- "
                if self.lists and self.lists[-1][0] == "ol":
                    n = _number(attributes.get("value"), self.lists[-1][1])
                    self.lists[-1][1] = n + 1
                    mark = f"{n}. "
                self.flow.indent.append(" " * len(mark))
                self.flow.mark = mark
                undo = "indent"
            elif tag in ("dd", "blockquote"):
                self.flow.indent.append("  ")
                undo = "indent"
            elif tag in ("pre", "textarea"):
                self.pre += 1
                undo = "pre"
        elif tag == "q" and not self.unseen:
            self.flow.text("“", False)
        self._push(tag, undo)

    @property
    def in_foreign(self) -> bool:
        return bool(self.foreign) and self.foreign[-1]

    def _open_foreign(self, tag: str, raw: str) -> None:
        """Open an element of svg or math, unless it closes itself."""
        if _self_closed(raw):
            return
        attributes = self._attributes(raw) if raw and not raw.isspace() else {}
        name = "/" + tag
        if tag in ("svg", "math"):
            self.foreign.append(True)
        elif tag in HTML_AGAIN:
            self.foreign.append(tag == "annotation-xml" and attributes.get("encoding", "").lower() not in ("text/html", "application/xhtml+xml"))
        off = tag in FOREIGN_HIDDEN or attributes.get("display", "").strip().lower() == "none" or bool(_INVISIBLE.search(attributes.get("style", "")))
        if off or self.hidden:
            self.hidden += 1
            self._push(name, "hidden")
            return
        self._see(attributes)
        if name in FOREIGN_APART:
            self._apart()
        self._push(name, None)

    def _leave_foreign(self) -> None:
        while self.in_foreign:
            self._pop()

    def _apart(self) -> None:
        if not self.unseen:
            self.flow.text(" ", bool(self.pre))

    def _unseen(self, attributes: dict[str, str]) -> bool:
        """Whether an element with these attributes is invisible where it stands."""
        said = _VISIBILITY.findall(attributes.get("style", "")) or ([attributes["visibility"]] if self.in_foreign and "visibility" in attributes else [])
        value = said[-1].strip().lower() if said else ""
        return value in ("hidden", "collapse") or (self.unseen and value not in ("visible", "initial"))

    def _see(self, attributes: dict[str, str]) -> None:
        """Set the visibility of an element that is about to be put on the stack."""
        if attributes and (unseen := self._unseen(attributes)) != self.unseen:
            self.visibility.append((len(self.stack), self.unseen))
            self.unseen = unseen

    @staticmethod
    def _attributes(raw: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTE.findall(raw):
            value = a or b or c
            out.setdefault(name.lower(), unescape(value) if "&" in value else value)
        return out

    def _end(self, ends: set[str], stop: set[str] | frozenset[str]) -> None:
        """Close down to the outermost of ``ends`` that is open within the nearest of ``stop``."""
        found = [self.places[tag] for tag in ends if self.places.get(tag)]
        if not found:
            return
        wall = max((self._last(tag) for tag in stop if tag not in ends), default=-1)
        inside = [p[i] for p in found if (i := bisect_right(p, wall)) < len(p)]
        at = min(inside, default=-1)
        while at >= 0 and len(self.stack) > at:
            self._pop()

    def close(self, tag: str) -> None:
        if tag in ("p", "br") and self.in_foreign:
            self._leave_foreign()
        if tag == "p" and not self.hidden and not self.places.get("p"):
            self.flow.margin()
            return
        if tag == "br":
            self.open("br", "")
            return
        wall = BARRIER if tag not in ("table", "html", "tr", "tbody", "thead", "tfoot") else frozenset({"table"})
        at = max(self._last(tag), self._last("/" + tag))
        if at >= 0 and at >= max(map(self._last, wall)):
            while len(self.stack) > at:
                self._pop()

    def _last(self, tag: str) -> int:
        """The place of the innermost open element of this name, or -1."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def _push(self, tag: str, undo: object) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, undo))

    def _pop(self) -> None:
        tag, undo = self.stack.pop()
        self.places[tag].pop()
        if tag[0] == "/" and (tag in ("/svg", "/math") or tag[1:] in HTML_AGAIN):
            self.foreign.pop()
        if undo == "hidden":
            self.hidden -= 1
            return
        if tag in FOREIGN_APART:
            self._apart()
        unseen = self.unseen
        if self.visibility and self.visibility[-1][0] == len(self.stack):
            self.unseen = self.visibility.pop()[1]
        if tag == "table":
            table, outer = self.tables.pop()
            self.flow = outer
            outer.margin()
            outer.block(table.drawn())
            outer.margin()
        elif tag in ("td", "th"):
            table, outer = self.tables[-1]
            table.rows[-1].append((self.flow.done(), undo))
            self.flow = outer
        elif tag == "caption" and self.tables:
            table, outer = self.tables[-1]
            table.caption += self.flow.done()
            self.flow = outer
        elif tag in BLOCK and tag not in ("tr", "thead", "tbody", "tfoot"):
            self.flow.margin() if tag in MARGIN and not (tag in ("ul", "ol") and len(self.lists) > 1) else self.flow.line()
            if tag in ("ul", "ol", "menu", "dir"):
                self.lists.pop()
            elif undo == "indent":
                if self.flow.mark:  # an item without text
                    self.flow.mark = ""
                self.flow.indent.pop()
            elif undo == "pre":
                self.pre -= 1
        elif tag == "q" and not unseen:
            self.flow.text("”", False)

    def finish(self) -> str:
        while self.stack:
            self._pop()
        return "\n".join(self.flow.done())


def render(html: str | None) -> str:
    """The visible text of a page."""
    page = _Page()
    s, at = html or "", 0
    search = _TOKEN.search
    while (m := search(s, at)) is not None:
        if m.start() > at:
            page.text(s[at : m.start()])
        at = m.end()
        if page.in_foreign and s.startswith("<![CDATA[", m.start()):
            stop = s.find("]]>", m.start())
            body = s[m.start() + 9 : stop if stop >= 0 else len(s)]
            at = stop + 3 if stop >= 0 else len(s)
            page.text(body.replace("&", "&amp;"))
            continue
        end, start, raw = m[1], m[2] or m[4], m[3] or m[5] or ""
        if end:
            page.close(end.lower())
        elif start:
            tag = start.lower()
            foreign = page.in_foreign
            page.open(tag, raw)
            if tag in RAW and not foreign:
                stop = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(s, at) if tag != "plaintext" else None
                body = s[at : stop.start() if stop else len(s)]
                at = stop.start() if stop else len(s)
                page.text(body[1:] if tag == "textarea" and body[:1] == "\n" else body)
    if at < len(s):
        page.text(s[at:])
    return page.finish()


_LANG_VALUE = re.compile(r"\s*([a-zA-Z]{2,3})\b")


def declared_language(html: str | None) -> str | None:
    """The primary language tag of the markup: the first start tag of html with a lang attribute, or of meta with a content-language.

    Comments and the content of scripts and the like declare nothing. The page is read once, up to that tag.
    """
    s, at = html or "", 0
    if not re.search("lang", s, re.I):
        return None
    while (m := _TOKEN.search(s, at)) is not None:
        at = m.end()
        tag = (m[2] or m[4] or "").lower()
        if tag in ("html", "meta"):
            own = {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(m[3] or m[5] or "")}
            value = (own.get("lang") or own.get("xml:lang")) if tag == "html" else own.get("content") if (own.get("http-equiv") or own.get("name") or "").strip().lower() == "content-language" else None
            if value and (found := _LANG_VALUE.match(value)):
                return found[1].lower()
        elif tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(s, at) if tag != "plaintext" else None
            at = stop.start() if stop else len(s)
    return None


def extract(pages: DataFrame, *, html_col: str = "html", keep: list[str] | None = None, name: str = "text") -> DataFrame:
    """The columns of ``keep`` (default: all but the markup) and the visible text."""
    ops.bounded(pages.sparkSession)
    held = [c for c in pages.columns if c != html_col] if keep is None else keep

    def make():
        return lambda batch: {name: [render(h) for h in batch.column(html_col).to_pylist()]}

    return ops.map_text(pages, html_col, make, [(name, "string")], held)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract(ops.read(spark, sf_dir, "pages"), keep=["page_id"]).withColumn("n_lines", F.size(F.split("text", "\n")))
