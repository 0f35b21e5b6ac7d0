"""Sources behind one contract, as a Spark data source: ``spark.read.format("facts").load(folder)``.

A folder holds a folder for each source, and that its payloads: bundles (``records`` with triples and narratives) and entity claims, as
JSON. Each payload is a partition of its own. Filters on ``source_name`` reach the source, which then lists only those sources' folders.

    register(spark)
    spark.read.format("facts").option("kind", "narratives").option("mode", "live").option("live", "/mnt/fetched").load("/mnt/fixtures")

Modes: ``offline`` and ``dry-run`` read the folder; ``live`` reads the folder of option ``live``, where a fetching job leaves its payloads, and
falls back to the other for every source that has nothing readable there. What is a dry run is for a writer to know: its rows say so in ``fetched_by``.

Payloads are opened by Python in the tasks, so the folder has to be mounted on every machine; for stores that only Spark reads
there are ``tables.read_bundle`` and ``tables.read_claims``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

MODES = ("offline", "dry-run", "live")
_META = "source_name string, source_title string, fetched_by string, used_fallback boolean, record_no int, pos int"
SCHEMAS = {
    "triples": f"{_META}, subject string, relation string, object string, raw string",
    "narratives": f"{_META}, page_title string, section string, content string",
}


@dataclass
class Payload(InputPartition):
    """A file of a source; a fallback's rows say so."""

    source: str
    path: str
    used_fallback: bool

    def __init__(self, source: str, path: str, used_fallback: bool):
        super().__init__((source, path))
        self.source, self.path, self.used_fallback = source, path, used_fallback


def _loaded(path: str) -> dict | None:
    """A payload's object, or None if it can't be read or is none."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _claim_value(claim: dict) -> str | None:
    """An entity's main value: amount and unit id, an id, a text or a time, whichever is there; null for none."""
    value = ((claim.get("mainsnak") or {}).get("datavalue") or {}).get("value")
    if not isinstance(value, dict):
        return _text(value)
    if value.get("amount"):
        unit = str(value.get("unit") or "").rpartition("/")[2]
        return " ".join(p for p in (str(value["amount"]).removeprefix("+"), unit if unit.startswith("Q") else "") if p)
    return next((_text(value[k]) for k in ("id", "text", "time") if value.get(k)), None)


def _triples(payload: dict, properties: dict[str, str]) -> Iterator[tuple]:
    """(title, record number, place, subject, relation, object, raw) of bundles and of claims."""
    for n, record in enumerate(payload.get("records") or []):
        for i, t in enumerate(record.get("triples") or []):
            yield record.get("title"), n, i, _text(t.get("subject")), _text(t.get("relation")), _text(t.get("object")), _text(t.get("raw"))
    for n, (key, entity) in enumerate((payload.get("entities") or {}).items()):
        labels = entity.get("labels") or {}
        name = next((labels[lang]["value"] for lang in ("zh-hans", "zh", "en") if (labels.get(lang) or {}).get("value")), key)
        known = [(p, c) for p, claims in (entity.get("claims") or {}).items() if p in properties for c in claims]
        for i, (p, claim) in enumerate(known):
            if value := _claim_value(claim):
                yield name, n, i, name, properties[p], value, p


def _narratives(payload: dict, _: dict[str, str]) -> Iterator[tuple]:
    for n, record in enumerate(payload.get("records") or []):
        for i, t in enumerate(record.get("narratives") or []):
            yield record.get("title"), n, i, _text(t.get("page_title") or record.get("title")), _text(t.get("section")), _text(t.get("content"))


class FactsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.kind, self.mode = options.get("path", ""), options.get("kind", "triples"), options.get("mode", "offline").strip().lower()
        if self.mode not in MODES or self.kind not in SCHEMAS:
            raise ValueError(f"mode is one of {MODES}, kind one of {tuple(SCHEMAS)}")
        self.live, self.properties = options.get("live", ""), json.loads(options.get("properties", "{}"))
        self.sources: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the source's name are answered by what is listed, all others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source_name",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("source_name",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.sources = wanted if self.sources is None else self.sources & wanted

    def _listed(self, top: str) -> dict[str, list[str]]:
        """The payloads of each wanted source."""
        if not os.path.isdir(top):
            return {}
        names = [n for n in sorted(os.listdir(top)) if (self.sources is None or n in self.sources) and os.path.isdir(os.path.join(top, n))]
        return {n: [os.path.join(top, n, f) for f in sorted(os.listdir(os.path.join(top, n))) if f.endswith(".json")] for n in names}

    def partitions(self) -> list[Payload]:
        stored = self._listed(self.folder)
        if self.mode != "live":
            return [Payload(n, p, False) for n, paths in stored.items() for p in paths]
        fetched = {n: good for n, paths in self._listed(self.live).items() if (good := [p for p in paths if _loaded(p) is not None])}
        live = [Payload(n, p, False) for n, paths in fetched.items() for p in paths]
        return live + [Payload(n, p, True) for n, paths in stored.items() if n not in fetched for p in paths]

    def read(self, partition: Payload | None) -> Iterator[tuple]:
        if partition is None:  # nothing was listed
            return
        payload = _loaded(partition.path) or {}
        by = "offline" if partition.used_fallback else self.mode
        for title, number, place, *rest in (_triples if self.kind == "triples" else _narratives)(payload, self.properties):
            yield (partition.source, title, by, partition.used_fallback, number, place, *rest)


class FactsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "facts"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "triples")]

    def reader(self, schema) -> FactsReader:
        return FactsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FactsSource)
