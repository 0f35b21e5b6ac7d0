"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training text.

Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters. A window is ``ngram``
consecutive words of an item; an item of fewer words is one window, an item without words has none.

The set is broadcast only up to ``max_words`` words of items. A larger benchmark is dealt by hash into blocks of about
that size; the corpus is scanned for one block after the other, each broadcast freed before the next, and the hits
(word ranges and item ids of documents, kept by 128 bits of id-free content) are joined back to the documents. So neither
the driver nor a task ever holds more than one block. A window whose hash is in the set is compared word for word, so
results are exact and the same for any ``max_words``.

Defined results: null or empty text has no words and is never contaminated; items with null text never
occur; repeated documents and items count one by one (an item id is reported once per document, a null
id as ''); an empty benchmark hits nothing; input columns with the names of the new ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textops as ops

NGRAM = 13
MAX_WORDS = 300_000
#: Share of hit words from which a document is contaminated: 20 * n_hit >= n_words.
SHARE = 20
_FILTER_BITS = 22


def _item_words(text: str) -> list[bytes]:
    data = np.frombuffer((text or "").encode().translate(ops.LOWER_TABLE), np.uint8)
    w = ops.Words(data, np.array([0, len(data)]), ops.WORD_ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]


def _windows(items: list[tuple[str, str]], ngram: int) -> dict[int, dict[bytes, tuple[str, ...]]]:
    """By length: the windows (words joined by a space) with the ids of their items."""
    found: dict[int, dict[bytes, set[str]]] = {}
    for item, text in items:
        words = _item_words(text)
        k = min(ngram, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            found.setdefault(k, {}).setdefault(b" ".join(words[i : i + k]), set()).add(item)
    return {k: {w: tuple(sorted(s)) for w, s in v.items()} for k, v in found.items()}


class _Scanner:
    """Finds the windows of one block in slices of text."""

    def __init__(self, windows: dict[int, dict[bytes, tuple[str, ...]]]):
        self.by_length = []
        for k, table in sorted(windows.items()):
            joined = list(table)
            data = np.frombuffer(b"".join(joined), np.uint8)
            ends = np.cumsum([len(w) for w in joined])
            w = ops.Words(data, np.concatenate([[0], ends]), ops.WORD_ALNUM)
            hashes = ops.sequence_hashes(w.hashes(), k)[w.ptr[:-1]]
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_length.append((k, table, np.sort(hashes), seen))

    def scan(self, w: ops.Words, raw: bytes, items: list[set[str]]) -> np.ndarray:
        """Marks the hit words; adds to the items of each text."""
        n = len(w.start)
        hit = np.zeros(n + 1, np.int32)
        if not n or not self.by_length:
            return hit[:-1] > 0
        hashes, doc = w.hashes(), None
        for k, table, known, seen in self.by_length:
            h = ops.sequence_hashes(hashes, k)
            at = np.flatnonzero(seen[h >> np.uint64(64 - _FILTER_BITS)])
            at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]
            if not len(at):
                continue
            doc = w.doc() if doc is None else doc
            for i in at[doc[at] == doc[at + k - 1]].tolist():
                text = b" ".join(raw[a:b] for a, b in zip(w.start[i : i + k].tolist(), w.end[i : i + k].tolist(), strict=True))
                if text in table:
                    items[doc[i]].update(table[text])
                    hit[i] += 1
                    hit[i + k] -= 1
        return np.cumsum(hit[:-1]) > 0


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_words: int) -> tuple[DataFrame, int]:
    """The benchmark's items (item, text, block) in blocks of about max_words words; usually one."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # A word and the separator after it take two bytes at least, so this bounds the words.
    words = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    n = max(1, int(-(-words // max_words)))
    return items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")), n


def _block_windows(items: DataFrame, block: int, ngram: int) -> dict[int, dict[bytes, tuple[str, ...]]]:
    return _windows([(r.item, r.text) for r in items.where(F.col("block") == block).select("item", "text").collect()], ngram)


class _Found:
    """Hits in the texts of a slice: which words, and for each text the items."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = ops.text_buffers(column)
        lower = ops.LOWER[self.data]
        self.words = ops.Words(lower, self.offsets, ops.WORD_ALNUM)
        self.raw = lower.tobytes()
        self.items: list[set[str]] = [set() for _ in range(len(column))]
        self.hit = np.zeros(len(self.words.start), bool)

    def scan(self, scanner: _Scanner) -> None:
        self.hit |= scanner.scan(self.words, self.raw, self.items)

    def runs(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last words of the runs of hit words of text d, counted over the slice."""
        a, b = self.words.ptr[d], self.words.ptr[d + 1]
        edge = np.diff(np.concatenate([[0], self.hit[a:b].astype(np.int8), [0]]))
        return a + np.flatnonzero(edge == 1), a + np.flatnonzero(edge == -1) - 1

    def columns(self, texts: list[str | None] | None) -> dict[str, object]:
        """The result's columns; ``texts`` lose their hit runs."""
        w = self.words
        total = np.concatenate([[0], np.cumsum(self.hit)])
        n_words, n_hit = np.diff(w.ptr), total[w.ptr[1:]] - total[w.ptr[:-1]]
        spans: list[list[dict[str, int]]] = [[] for _ in self.items]
        original = self.data.tobytes() if n_hit.any() else b""
        for d in np.flatnonzero(n_hit).tolist():
            first, last = self.runs(d)
            base, chars, done = int(self.offsets[d]), 0, int(self.offsets[d])
            for i, j in zip(w.start[first].tolist(), w.end[last].tolist(), strict=True):
                start = chars + len(original[done:i].decode())
                chars, done = start + len(original[i:j].decode()), j
                spans[d].append({"first": start, "past": chars})
            if texts is not None:
                whole = original[base : int(self.offsets[d + 1])].decode()
                cuts = [0, *(x for s in spans[d] for x in (s["first"], s["past"])), len(whole)]
                texts[d] = "".join(whole[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
        return {
            "n_words": n_words,
            "n_hit": n_hit,
            "n_items": [len(s) for s in self.items],
            "items": [sorted(s) for s in self.items],
            "hit_spans": spans,
            "contaminated": (n_hit > 0) & (SHARE * n_hit >= n_words),
        }


def _hits(docs: DataFrame, text_col: str, windows: Broadcast) -> DataFrame:
    """(k1, k2, first, past, items) of the texts with hits: runs of words from first to past - 1."""

    def run(batches):
        scanner = _Scanner(windows.value)
        for part in ops.text_slices(batches, text_col):
            found = _Found(part.column(text_col))
            found.scan(scanner)
            rows = [d for d, s in enumerate(found.items) if s]
            runs = [(a - found.words.ptr[d], b + 1 - found.words.ptr[d]) for d in rows for a, b in [found.runs(d)]]
            own = part.select(["k1", "k2"]).take(pa.array(rows, pa.int64()))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([a for a, _ in runs], longs), pa.array([b for _, b in runs], longs), pa.array([sorted(found.items[d]) for d in rows], pa.list_(pa.string()))], names=["k1", "k2", "first", "past", "items"])

    return docs.select("k1", "k2", text_col).mapInArrow(run, "k1 bigint, k2 bigint, first array<bigint>, past array<bigint>, items array<string>").dropDuplicates(["k1", "k2"])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    keep: list[str] | None = None,
    item_id: str = "item_id",
    item_text: str = "text",
    ngram: int = NGRAM,
    max_words: int = MAX_WORDS,
    remove_spans: bool = False,
) -> DataFrame:
    """The columns of ``keep`` (default: all) with n_words, n_hit, n_items, items, hit_spans, contaminated.

    ``hit_spans`` has [first, past last) character ranges of the hit words' runs. With ``remove_spans`` the
    text column is returned without them. With a benchmark of one block it is map-only: nothing is shuffled.
    """
    spark = docs.sparkSession
    ops.bounded(spark)
    items, n = _blocks(benchmark, item_id, item_text, max_words)
    fields = [("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items", "array<string>"), ("hit_spans", "array<struct<first:bigint,past:bigint>>"), ("contaminated", "boolean")]
    fields += [(text_col, "string")] if remove_spans else []
    names = docs.columns if keep is None else keep
    if n == 1:
        sent = spark.sparkContext.broadcast(_block_windows(items, 0, ngram))

        def make():
            scanner = _Scanner(sent.value)

            def work(batch: pa.RecordBatch) -> dict[str, object]:
                found = _Found(batch.column(text_col))
                found.scan(scanner)
                texts = batch.column(text_col).to_pylist() if remove_spans else None
                return found.columns(texts) | ({text_col: texts} if texts is not None else {})

            return work

        return ops.map_text(docs, text_col, make, fields, names)
    # Rows of one text have the same hits, so the text alone is the key.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), F.xxhash64(F.lit(1), text_col).alias("k1"), F.xxhash64(text_col, F.lit(2)).alias("k2"))
    hits = None
    for block in range(n):
        windows = spark.sparkContext.broadcast(_block_windows(items, block, ngram))
        own = ops.cut(_hits(keyed, "text", windows))
        windows.destroy()
        hits = own if hits is None else hits.unionByName(own)
    each = hits.groupBy("k1", "k2").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("first", "past", "items")))
    joined = keyed.join(each, ["k1", "k2"], "left")

    def finish():
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            found = _Found(batch.column("text"))
            for d, (first, past, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("first", "past", "items")), strict=True)):
                base = int(found.words.ptr[d])
                for a, b in zip(first or [], past or [], strict=True):
                    found.hit[base + a : base + b] = True
                found.items[d].update(own or [])
            texts = batch.column("text").to_pylist() if remove_spans else None
            out = found.columns(texts)
            return {f"_{k}": v for k, v in out.items()} | ({"_text": texts} if texts is not None else {})

        return work

    made = ops.map_text(joined, "text", finish, [("_text" if f == text_col else f"_{f}", t) for f, t in fields], ["row"], need=("first", "past", "items"))
    new = {f for f, _ in fields}
    return made.select(*(F.col("row")[c].alias(c) for c in names if c not in new), *(F.col("_text" if f == text_col else f"_{f}").alias(f) for f, _ in fields))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over documents and benchmark."""
    found = decontaminate(ops.read(spark, sf_dir, "documents"), ops.read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select item_id, words, least(13, len(words)) as k from (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark) where len(words) > 0),
w as (select distinct cast(item_id as varchar) as item, k, array_to_string(words[i:i + k - 1], ' ') as win from b, unnest(range(1, len(words) - k + 2)) as t(i)),
lengths as (select distinct k from w),
p as (select rid, i, k, array_to_string(words[i:i + k - 1], ' ') as win from d, unnest(range(1, len(words) + 1)) as t(i), lengths where i + k - 1 <= len(words)),
h as (select rid, i, p.k, item from p join w on p.k = w.k and p.win = w.win),
n as (select rid, count(*) as n_hit from (select distinct rid, unnest(range(i, i + k)) as at from h) group by rid),
s as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from h) group by rid)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(words) as contaminated from d left join n using (rid) left join s using (rid)"""


def brute_force(docs: list[tuple], items: list[tuple], ngram: int = NGRAM) -> dict:
    """Plain Python version for tests: doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    import re

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            k = min(ngram, len(b))
            wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out
