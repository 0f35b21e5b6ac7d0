"""Terms of a dictionary in texts: which of them each text has, and the division of texts into words.

A dictionary is dealt over shards of about ``SHARD_SIGNS`` signs, by the hash of a term; each shard is one broadcast
automaton of bounded size, and the texts are read once for each. With one shard, as most dictionaries have, nothing is
shuffled. To divide texts the most frequent words are one automaton, and all others are found by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import automaton, wordtable
from factloom.sources.tables import cut

#: Signs of a shard's terms; its arrays take some 40 bytes a sign at most.
SHARD_SIGNS = 1 << 22
#: Signs of words that an automaton takes beside tables: first those of ``SHORT``, none longer than ``LONG``.
SHORT, LONG = 3, 64
#: Words of a table (some 30 bytes each), and words that the driver reads at a time.
TABLE_WORDS, CHUNK_WORDS = 1 << 24, 1 << 18
#: Signs of texts that a task reads at a time, or one text.
SLICE_SIGNS = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batches in slices of about ``SLICE_SIGNS``, with their texts; only one slice's texts are Python strings at a time."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_SIGNS, side="right")))
            part = batch.slice(at, to - at)
            yield part, part.column(column).to_pylist()
            at = to


def _shards(dictionary: DataFrame, shard_signs: int) -> list[DataFrame]:
    """The dictionary's different terms (column term, not empty), in parts of about ``shard_signs``."""
    terms = dictionary.select("term").where(F.length("term") > 0).distinct()
    n = -(-(terms.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]) // shard_signs) or 1
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i) for i in range(n)] if n > 1 else [terms]


def found_terms(df: DataFrame, key: Sequence[str], column: str, dictionary: DataFrame, *, shard_signs: int = SHARD_SIGNS) -> DataFrame:
    """(key, terms): for each row the different terms of the dictionary (column term) that stand anywhere in its text, sorted.

    With several shards rows are told apart by ``key``, which has to be unique then.
    """
    fields = [df.schema[k] for k in key]
    schema = T.StructType([*fields, T.StructField("terms", T.ArrayType(T.StringType()))])
    rows = df.select(*dict.fromkeys([*key, column]))

    def one(part: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(sorted(part.toArrow()["term"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = automaton.Automaton(sent.value)
            for batch, texts in slices(batches, column):
                text, _, term = own.find_in(texts)
                both = np.unique(text * max(len(sent.value), 1) + term)
                at = np.searchsorted(both, np.arange(len(texts) + 1) * max(len(sent.value), 1))
                names = pa.array(sent.value, pa.string()).take(pa.array(both % max(len(sent.value), 1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.ListArray.from_arrays(pa.array(at, pa.int32()), names)], names=[*key, "terms"])

        return rows.mapInArrow(run, schema)

    parts = [one(p) for p in _shards(dictionary, shard_signs)]
    if len(parts) == 1:
        return parts[0]
    # Each shard's finds are written before the next is read.
    out = None
    for part in map(cut, parts):
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("terms"))).alias("terms"))


def word_counts(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """(term, n): how often each match of a pattern stands in the texts; words add up in their task before they are shuffled."""
    words = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(f"({pattern})"))
    return df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _flags(code: np.ndarray, chosen: list[int]) -> np.ndarray:
    """Which signs are among the chosen."""
    table = np.zeros(int(code.max(initial=0)) + 1, bool)
    table[chosen] = True
    return table[code]


#: A word that stands in a text, for the next pass over it.
_FOUND = np.dtype([("end", "<i8"), ("size", "<i8"), ("gain", "<f8")])


class _Runs:
    """Texts side by side, with their runs of letters and digits."""

    def __init__(self, texts: Sequence[str | None]):
        self.whole = "\u0000".join(t or "" for t in texts)  # a sign between texts that belongs to no run
        self.code = automaton.signs(self.whole)
        long = np.array([len(t or "") + 1 for t in texts], np.int64)
        self.begin = np.cumsum(long) - long
        self.kinds = np.flatnonzero(np.bincount(self.code)).tolist()
        inside = _flags(self.code, [c for c in self.kinds if chr(c).isalnum()])
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        self.start = np.flatnonzero(edge == 1)
        self.length = np.flatnonzero(edge == -1) - self.start

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, side="right") - 1


def _divide(runs: _Runs, by: automaton.Divider, more: tuple[np.ndarray, np.ndarray, np.ndarray] | None, alone: Sequence[int]) -> pa.ListArray:
    """Each text's words by best paths through its runs. more: (end, size, gain) of words that the divider lacks; alone: the signs among all of these."""
    start, known = runs.start, {*by.own.alone, *alone}
    # Signs of scripts that put no blanks between words stay by themselves, others that no word covers join their neighbours.
    joining = _flags(runs.code, [c for c in runs.kinds if c not in known and not (0x2E80 <= c < 0xFB00 or c >= 0x20000)])
    run, last = by.paths(runs.code, start, runs.length, more)
    last = last + start[run]
    first = np.where(np.append(True, run[1:] != run[:-1])[: len(run)], start[run], np.append(0, last[:-1])[: len(run)])
    # Unknown signs join the ones before them in their run.
    free = (last - first == 1) & joining[first]
    joins = np.append(False, free[1:] & free[:-1] & (run[1:] == run[:-1]))[: len(run)]
    first, last = first[~joins], last[np.append(~joins[1:], True)[: len(run)]]
    # The words' bytes one behind the other; runs are words from end to end.
    width = 1 + (runs.code >= 0x80).astype(np.int8) + (runs.code >= 0x800) + (runs.code >= 0x10000)
    size = np.append(0, np.cumsum(width, dtype=np.int64))
    inside = np.zeros(len(runs.code), bool)
    inside[automaton.ranges(start, runs.length)] = True
    data = np.frombuffer(runs.whole.encode(), np.uint8)[np.repeat(inside, width)]
    ends = np.append(0, np.cumsum(size[last] - size[first]))
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, np.append(runs.begin, len(runs.code) + 1)), pa.int32()), words)


def _gains(n: pa.ChunkedArray, total: float) -> np.ndarray:
    return np.log(n.to_numpy().astype(float)) - np.log(total)


def _tables(words: DataFrame, tables: int, chunks: int, total: float) -> Iterator[wordtable.WordTable]:
    """The words (term, n), dealt over tables by their hashes; the driver reads a chunk at a time."""
    lengths = [r[0] for r in words.select(F.length("term")).distinct().collect()]
    dealt = F.pmod(F.xxhash64("term"), F.lit(tables * chunks))

    def read(k: int) -> tuple[list[str], np.ndarray]:
        part = words.where(dealt == k).toArrow()
        return part["term"].to_pylist(), _gains(part["n"], total)

    for i in range(tables):
        yield wordtable.WordTable(lengths, (read(i * chunks + k) for k in range(chunks)))


def _with_found(rows: DataFrame, column: str, sent: Broadcast) -> DataFrame:
    """The rows with what a table's words find in each text, added to what is in _found."""
    kept = [c for c in rows.columns if c != "_found"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("_found", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, column):
            runs = _Runs(texts)
            end, size, gain = sent.value.find(runs.code, runs.start, runs.length)
            text = runs.text_of(end - 1)
            order = np.argsort(text, kind="stable")
            found = np.empty(len(end), _FOUND)
            found["end"], found["size"], found["gain"] = (end - runs.begin[text])[order], size[order], gain[order]
            at = np.searchsorted(text[order], np.arange(len(texts) + 1))
            before = batch.column("_found").to_pylist() if "_found" in batch.schema.names else [b""] * len(texts)
            both = [x + found[i:j].tobytes() for x, i, j in zip(before, at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(both, pa.binary())], names=[*kept, "_found"])

    return rows.mapInArrow(run, schema)


def _all_found(runs: _Runs, batch: pa.RecordBatch, table: wordtable.WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, size, gain) of what the last table and the ones before it find, by falling size."""
    found = table.find(runs.code, runs.start, runs.length)
    if "_found" not in batch.schema.names:
        return found
    before = [np.frombuffer(x, _FOUND) for x in batch.column("_found").to_pylist()]
    ends = np.concatenate([found[0], *(x["end"] + b for x, b in zip(before, runs.begin, strict=True))])
    sizes, gains = (np.concatenate([own, *(x[name] for x in before)]) for own, name in ((found[1], "size"), (found[2], "gain")))
    order = np.argsort(-sizes, kind="stable")
    return ends[order], sizes[order], gains[order]


def divided(df: DataFrame, key: Sequence[str], column: str, words: DataFrame, *, shard_signs: int = SHARD_SIGNS, table_words: int = TABLE_WORDS) -> DataFrame:
    """(key, words): each text's words, by the likeliest path over a lattice of known words.

    words: (term, n), each known word with its count; a word's probability is its share of all counts, and a sign that is no word counts as
    seen once. Runs of letters and digits are divided by themselves, all other signs are left out. Unknown signs that follow each other
    join, except in scripts without blanks. Of equally likely paths the one with the longest last word counts.

    Every word counts, however many there are: an automaton of at most ``shard_signs`` signs has the shortest and the most frequent ones,
    tables of ``table_words`` words by their hashes have all others. Texts are read once for each table; what all tables but the last
    find in a text is written beside it.
    """
    # Written once, as it is read several times and usually counted in a corpus.
    known = words.where(F.rlike("term", F.lit(r"^[\p{L}\p{N}]+$")) & (F.col("n") > 0)).select("term", F.col("n").cast("bigint").alias("n"))
    known = cut(known.groupBy("term").agg(F.max("n").alias("n"), F.sum("n").alias("_all")))
    total, many = known.agg(F.coalesce(F.sum("_all"), F.lit(0)), F.count("*")).first()
    total = float(total or 1)
    # Short words come first, as they stand nearly everywhere; then the most frequent ones.
    place = lambda n, term: F.struct(F.length(term) > SHORT, -n, term)
    first = known.where(F.length("term") <= LONG).orderBy(place(F.col("n"), F.col("term"))).limit(shard_signs // LONG).select("term", "n").toArrow()
    rest = known.select("term", "n")
    if len(first):
        rest = rest.where((F.length("term") > LONG) | (place(F.col("n"), F.col("term")) > place(F.lit(first["n"][-1].as_py()).cast("bigint"), F.lit(first["term"][-1].as_py()))))
    send = df.sparkSession.sparkContext.broadcast
    rows = df.select(*dict.fromkeys([*key, column]))
    rare, table, alone = many - len(first), None, []
    tables = -(-rare // table_words)
    for i, table in enumerate(_tables(rest, tables, -(-min(rare, table_words) // CHUNK_WORDS), total) if rare else []):
        alone += table.alone
        if i < tables - 1:
            rows = cut(_with_found(rows, column, send(table)))
    sent = send((automaton.Divider(automaton.Automaton(first["term"].to_pylist()), _gains(first["n"], total), -np.log(total)), table, alone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, table, alone = sent.value
        for batch, texts in slices(batches, column):
            runs = _Runs(texts)
            found = _divide(runs, by, _all_found(runs, batch, table) if table else None, alone)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), found], names=[*key, "words"])

    return rows.mapInArrow(run, T.StructType([*(df.schema[k] for k in key), T.StructField("words", T.ArrayType(T.StringType()))]))


def distinct_in_order(*lists: Column) -> Column:
    """All lists' values, each at its first place; nulls and empty ones are left out."""
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)), lambda x: x.isNotNull() & (x != "")))
