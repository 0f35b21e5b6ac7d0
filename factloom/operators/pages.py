"""Encyclopedia pages: clean DOM to infobox fields, sections and chunks; fact sheets and raw texts to facts.

Parsing runs in Arrow batches, one page at a time; everything after it is relational.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import dims
from factloom.functions import text, web
from factloom.operators import extraction

# Elements and classes that hold no content, and headings at which content ends.
NOISE_TAGS = frozenset("script style noscript template sup nav footer aside".split())
NOISE_CLASSES = ("reference", "navbox", "mw-editsection", "toc", "hatnote", "metadata", "sidebar", "ad")
END_HEADINGS = ("参考", "参见", "外部链接", "延伸阅读", "注释", "References", "See also", "External links", "Further reading", "Notes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INFOBOX_RELATIONS = {key: relation for relation, keys in dims.INFOBOX_KEYS.items() for key in keys}


class _Page(HTMLParser):
    """Sections by heading path, and the rows of the first infobox table."""

    def __init__(self):
        super().__init__()
        self.off = 0
        self.open: list[tuple[str, bool]] = []
        self.count: Counter[str] = Counter()
        self.path: list[tuple[int, str]] = []
        self.sections: list[tuple[str, list[str]]] = [("", [])]
        self.fields: list[tuple[str, str]] = []
        self.box = self.heading = 0
        self.boxes = 0
        self.cell: list[str] | None = None
        self.row: list[str] = []
        self.ended = False

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.handle_data("\n")
            return
        classes = (dict(attrs).get("class") or "").split()
        noise = tag in NOISE_TAGS or any(c.startswith(n) if n != "ad" else c == n for c in classes for n in NOISE_CLASSES)
        self.off += noise
        self.open.append((tag, noise))
        self.count[tag] += 1
        if self.off:
            return
        if tag == "table" and (self.box or (any("infobox" in c for c in classes) and not self.boxes)):
            self.box += 1
            self.boxes = 1
        elif self.box and tag == "tr":
            self.row = []
        elif self.box == 1 and tag in ("th", "td"):
            self.cell = []
        elif tag in ("h1", "h2", "h3"):
            level = int(tag[1])
            self.path = [p for p in self.path if p[0] < level] + [(level, "")]
            self.heading = level
        elif tag in ("p", "li", "div", "tr"):
            self.handle_data("\n")

    def handle_endtag(self, tag):
        if not self.count[tag]:
            return
        while self.open:
            name, noise = self.open.pop()
            self.count[name] -= 1
            if not self.off:
                self._closed(name)
            self.off -= noise
            if name == tag:
                break

    def _closed(self, tag):
        if tag == "table" and self.box:
            self.box -= 1
        elif self.box == 1 and tag in ("th", "td") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif self.box == 1 and tag == "tr" and len(self.row) >= 2 and self.row[0] and self.row[1]:
            self.fields.append((self.row[0], self.row[1]))
            self.row = []
        elif tag in ("h1", "h2", "h3") and self.heading:
            self.heading = 0
            title = " ".join(self.path[-1][1].split())
            self.path[-1] = (self.path[-1][0], title)
            self.ended = self.ended or any(title.startswith(e) for e in END_HEADINGS)
            self.sections.append((" > ".join(p[1] for p in self.path), []))

    def handle_data(self, data):
        if self.off:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif self.heading:
            self.path[-1] = (self.path[-1][0], self.path[-1][1] + data)
        elif not self.box and not self.ended:
            self.sections[-1][1].append(data)


def parse(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, sections array<struct<path, content>>, fields array<struct<field, value>>) of each page; null pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        section = pa.list_(pa.struct([("path", pa.string()), ("content", pa.string())]))
        field = pa.list_(pa.struct([("field", pa.string()), ("value", pa.string())]))
        for batch in batches:
            sections, fields = [], []
            for page in batch.column(1).to_pylist():
                p = _Page()
                p.feed(page or "")
                p.close()
                clean = ((path, "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)) for path, parts in p.sections)
                sections.append([{"path": a, "content": b} for a, b in clean if b])
                fields.append([{"field": a, "value": b} for a, b in p.fields])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sections, section), pa.array(fields, field)], names=[key, "sections", "fields"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, sections array<struct<path:string,content:string>>, fields array<struct<field:string,value:string>>")


def section_rows(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(key, F.posexplode("sections").alias("section_no", "s")).select(key, "section_no", "s.path", "s.content")


def chunk_rows(parsed: DataFrame, key: str, marks: str = "。！？；;.!?") -> DataFrame:
    """(key, section_no, path, chunk_index, content): each section cut to chunks of 120 to 800 characters."""
    rows = section_rows(parsed, key)
    return rows.select(key, "section_no", "path", F.posexplode(extraction.packed_chunks(F.col("content"), marks)).alias("chunk_index", "content"))


def infobox_facts(parsed: DataFrame, key: str, relations: dict[str, str] = INFOBOX_RELATIONS) -> DataFrame:
    """(subject, relation, object, raw, pattern, ordinal) of known infobox keys; an atmosphere gives a fact for each component."""
    rows = parsed.select(key, F.posexplode("fields").alias("pos", "f"))
    name = F.lower(F.regexp_replace("f.field", r"[\s\[\(（].*$", ""))
    relation = F.coalesce(text.mapped(F.lower(F.trim("f.field")), relations), text.mapped(name, relations))
    objects = F.when(relation == "HAS_ATMOSPHERE", extraction.components(F.col("f.value"))).otherwise(F.array("f.value"))
    facts = rows.select(F.col(key).cast("string").alias("subject"), relation.alias("relation"), F.explode(objects).alias("object"), F.concat_ws(": ", "f.field", "f.value").alias("raw"), F.lit("infobox").alias("pattern"), F.col("pos").cast("long").alias("ordinal"))
    return facts.where("relation is not null and length(object) > 0")


def fact_sheet(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, relation, value) of fact-sheet tables: mass, mean radius and atmosphere by the first field that names them.

    The field's unit (10^24 kg, km) joins the number. A distance from the Sun becomes a flagged ORBITS hint.
    """
    pairs = pages.select(F.col(key).alias("key"), F.posexplode(web.table_rows(F.col(html))).alias("pos", "r")).select("key", "pos", "r.field", "r.value")
    unit = F.when(F.rlike(F.lower("field"), F.lit(r"10\^?\s*24\s*kg")), "e24 kg").when(F.contains("field", F.lit("kg")), " kg").when(F.contains("field", F.lit("km")), " km").otherwise("")
    value = F.concat("value", unit)
    named = extraction.fact_rows(pairs.withColumn("value", value), [("HAS_MASS", "mass"), ("HAS_RADIUS", "mean radius"), ("HAS_ATMOSPHERE", "atmosphere")])
    far = pairs.where(F.contains(F.lower("field"), F.lit("distance from sun"))).select("key", F.lit("ORBITS").alias("relation"), F.lit("太阳").alias("value"), F.lit(True).alias("derived")).dropDuplicates(["key"])
    return named.select(F.col("key").alias(key), "relation", "value", F.lit(False).alias("derived")).unionByName(far.withColumnRenamed("key", key))


def raw_text_facts(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, relation, object) from plain text: gases near 'atmosphere', what is orbited, the system a satellite is part of."""
    t = F.coalesce(F.col(column), F.lit(""))
    about = F.rlike(t, F.lit(r"(?i)atmosphere|大气"))
    gas = F.filter(F.array(*(F.when(about & F.rlike(t, F.lit(rf"(?i)(?<![a-z0-9])(?:{'|'.join(dims.GAS_NAMES[g])})(?![a-z0-9])")), g) for g in dims.GAS_ORDER)), lambda g: g.isNotNull())
    orbit = F.nullif(F.regexp_extract(t, r"(?i)\borbits (?:around )?(?:the )?([A-Z][a-z]+)", 1), F.lit(""))
    system = F.nullif(F.regexp_extract(t, r"(?i)\b(?:moon|satellite) of (?:the )?([A-Z][a-z]+)", 1), F.lit(""))
    one = lambda r, c: F.when(c.isNotNull(), F.array(F.struct(F.lit(r).alias("relation"), c.alias("object")))).otherwise(F.array())
    facts = F.concat(F.transform(gas, lambda g: F.struct(F.lit("HAS_ATMOSPHERE").alias("relation"), g.alias("object"))), one("ORBITS", orbit), one("PART_OF", F.concat(system, F.lit(" system"))))
    return docs.select(key, F.explode(facts).alias("f")).select(key, "f.relation", "f.object")


def keep_until(rows: DataFrame, key: str, order: str, stop: Column) -> DataFrame:
    """Rows of each key before the first (by order) at which ``stop`` holds."""
    first = rows.where(stop).groupBy(key).agg(F.min(order).alias("_stop"))
    return rows.join(first, key, "left").where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")
