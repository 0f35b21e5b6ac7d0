"""Shared helpers: Arrow batches in bounded slices, word spans and rolling hashes in numpy.

Spark partitions and shuffles the rows; these helpers only see one slice of a batch at a time
(``SLICE_BYTES`` of text, or one document where a single text is longer).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
#: Arrow batches between the JVM and Python hold at most so many bytes and rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096

# ASCII white space \x20 and \x09-\x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

WORD_WS = np.ones(256, np.uint8)
WORD_WS[list(SPACES)] = 0
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and every byte of a non-ASCII character.
WORD_ALNUM = np.zeros(256, np.uint8)
WORD_ALNUM[0x30:0x3A] = 1
WORD_ALNUM[0x61:0x7B] = 1
WORD_ALNUM[0x80:] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: For bytes.translate: lower-case A-Z and nothing else.
LOWER_TABLE = bytes(LOWER)

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WBASE = 0xD1342543DE82EF95
_WBASE_INV = pow(_WBASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, through Spark's reader."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded(spark: SparkSession) -> None:
    """Hold Arrow batches to a few megabytes, so that a worker's memory doesn't depend on text length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: the cluster's, or on a single machine where none is set (tests) one of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            import tempfile

            found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(found)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _POWERS[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a polynomial hash so that all its bits depend on all the input's."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a slice of texts: byte spans, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = table[data]
        before = np.zeros(n, np.uint8)
        after = np.zeros(n, np.uint8)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            first, last = offsets[:-1], offsets[1:] - 1
            before[first[first < n]] = 0
            after[last[last >= 0]] = 0
        self.start = np.flatnonzero(inside > before)
        self.end = np.flatnonzero(inside > after) + 1
        #: Words of text i are ptr[i] .. ptr[i + 1] - 1.
        self.ptr = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, worked out in blocks of about SLICE_BYTES."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, base + SLICE_BYTES, side="right")))
            part = self.data[base : self.end[j - 1]]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(part)), out=total[1:])
            begin = self.start[i:j] - base
            out[i:j] = mixed((total[self.end[i:j] - base] - total[begin]) * powers(_BASE_INV, len(part) + 1)[begin])
            i = j
        return out

    def doc(self) -> np.ndarray:
        """For each word the text that it belongs to."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes (across texts too; the caller masks those)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(_WBASE, n), out=total[1:])
    return mixed((total[k:] - total[:-k]) * powers(_WBASE_INV, n + 1)[: n - k + 1])


def starts_of_runs(ptr: np.ndarray, k: int) -> np.ndarray:
    """Positions of all runs of k words that lie within one text."""
    n = ptr[-1]
    ok = np.zeros(n + 1, np.int8)
    long = np.diff(ptr) >= k
    ok[ptr[:-1][long]] += 1
    np.subtract.at(ok, ptr[1:][long] - k + 1, 1)
    return np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def word_break(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where ASCII white space stands, or the end."""
    while at < len(data):
        blank = np.flatnonzero(WORD_WS[data[at : at + SLICE_BYTES]] == 0)
        if len(blank):
            return at + int(blank[0])
        at += SLICE_BYTES
    return len(data)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_binary(column.type):
        column = column.view(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about ``most`` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def map_text(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]],
    fields: list[tuple[str, str]],
    keep: list[str],
    need: tuple[str, ...] = (),
) -> DataFrame:
    """One output row for each row: the columns of ``keep``, and ``fields`` computed from slices of text.

    ``make()`` runs once in each task and returns the function for a slice. Kept columns whose names
    clash with ``fields`` give way to the new ones. Columns of ``need`` are there for the function only.
    """
    new = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    held = [c for c in keep if c not in new.fieldNames()]
    chosen = df.select(*dict.fromkeys([*held, column, *need]))
    schema = T.StructType([*(chosen.schema[c] for c in held), *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(new)
        work = make()
        for part in text_slices(batches, column):
            made = work(part)
            arrays = [part.column(c) for c in held] + [pa.array(made[f.name], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays(arrays, names=[*held, *new.fieldNames()])

    return chosen.mapInArrow(run, schema)


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str, text_col: str, most: dict[int, int], max_bytes: int = 1 << 16):
    """A pandas frame (text, label) to fit a classifier on: about ``most[label]`` rows of each label, fewer if there are fewer.

    Only rows whose id's crc32 modulo 3 is not 1, with label 0 or 1 and a text of at most ``max_bytes``.
    Rows are taken by the hash of their id, so the choice doesn't depend on their order; of rows that share an id
    the least text is taken. So the sample is bounded by ``most`` (up to the hash's spread), however often rows repeat.
    """
    rows = labels.where((id_remainder(id_col, 3) != 1) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, most[label] / n))).otherwise(share)
    # About sum(most) rows, whatever the input.
    chosen = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).where(F.octet_length("text") <= max_bytes)
    found = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "label").agg(F.min("text").alias("text")).select("text", "label").toPandas()
    return found.sort_values(["label", "text"], kind="stable", ignore_index=True)
