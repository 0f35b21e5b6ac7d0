"""Bulk-synchronous best-fit packing of tokenised documents into sequences of bounded length.

Documents are tokenised in place and cut only where they are longer than a sequence. Pieces as long as a sequence are
placed at once. Each round takes a band of lengths, the longest first, in three steps. Sort: the band's pieces and the
gaps that could hold one are sorted by size into ranges, each with its own task, as many rows of one size as there are
(numbered rows break ties, so a size shared by many rows is split over ranges). Sweep: each task goes down its range and
gives every piece its successor, the least gap left that holds it. Conflicts: what ranges leave over pairs across them by
rank, one gap and one piece of each range on each rank. Update: gaps shrink, pieces without a gap open
sequences, as many pieces in each as fit by their length, and the next round follows. The driver learns the lengths
in use (at most ``max_tokens``), to say where rounds begin; it decides no match. There are at most 7 + log8(max_tokens) rounds whatever the input.

Within a sequence pieces lie by falling length. With equal rows the result is one of several equal ones.

Defined results: null or empty text is the end token alone; repeated rows and null ids are packed like any
others; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.llm import textops as ops

MAX_TOKENS, END_ID = 2048, 0
#: Rows of a range in a round's sort.
ROWS_A_PART = 100_000
#: Sequence numbers are a multiple of this plus the number of the round that opened them; there are at most 7 + log8(max_tokens) rounds.
_ROUNDS = 64
#: Fixed value: the public split pattern of byte-level vocabularies.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unbroken runs from which a text goes to the slower encoder, whose time doesn't grow with a run's square.
_LONG_RUN = re.compile(r"\S{4000}|\s{4000}")
_TOKENIZERS: dict[str, Tokens] = {}


def default_tokenizer() -> str:
    """The vocabulary file; the package has the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Token ids of texts as little-endian uint32 bytes, as the vocabulary file says.

    A plain byte-level BPE file whose ids follow its merges has a second encoder, several times as fast, that
    merges by rank; it takes its ranks from the same file. All else goes to the file's own tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.fast = self._ranked(json.load(f))

    @staticmethod
    def _ranked(spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or spec["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(x + y) != 256 + i for i, (x, y) in enumerate(pairs)):
            return None
        # The printable bytes stand for themselves, the others for the characters from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        special = {t["content"] for t in spec["added_tokens"]}
        import tiktoken

        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def at(cls, path: str) -> Tokens:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if self.fast is not None and not any(s in text for s in self.special) and not (len(text) >= 4000 and _LONG_RUN.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def tokenize(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32[, ids]) of at most max_tokens; a cut document's first piece is the short one."""
    ops.bounded(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    fields = [("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")] + ([("ids", "binary")] if with_ids else [])
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields)).fields])

    def run(batches):
        tokens = Tokens.at(path)
        for part in ops.text_slices(batches, text_col):
            rows, piece, start, length, crc, body = [], [], [], [], [], []
            for row, ids in enumerate(map(tokens.ids, part.column(text_col).to_pylist())):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % max_tokens or max_tokens, n + 1, max_tokens)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    rows.append(row)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        body.append(own)
            arrays = [part.column(id_col).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(body, pa.binary())] if with_ids else []), names=schema.fieldNames())

    return docs.select(*dict.fromkeys([id_col, text_col])).mapInArrow(run, schema)


def bands(sizes: Iterable[int], max_tokens: int) -> list[tuple[int, int]]:
    """(shortest, longest) length of each round's pieces, long ones first: halves and thirds of a sequence, then halves of the last, then eighths."""
    left, out, part = sorted(sizes), [], 2
    while left:
        under = max_tokens // part if part <= 3 else left[-1] // (2 if left[-1] > max_tokens // 32 else 8)
        part += 1
        own = [n for n in left if n > under]
        if own:
            out.append((own[0], own[-1]))
            left = left[: len(left) - len(own)]
    return out


_STEP = "part int, seq bigint, at bigint"


def _sweep(rows: DataFrame) -> DataFrame:
    """One partition's successor sweep over rows (size, kind, seq, piece), longest first and gaps (kind 0) before pieces of their size.

    A piece takes the last gap that no other has taken: the least that holds it. Rows out: pieces with their gap's
    ``seq``, or the place ``at`` among the partition's pieces without one; then the gaps left, with theirs.
    """
    schema = T.StructType([*T._parse_datatype_string(_STEP).fields, rows.schema["piece"]])

    def run(batches):
        from pyspark import TaskContext

        part, free, n = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            keep, seq, at = [], [], []
            for i, (kind, gap) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("seq").to_pylist(), strict=True)):
                if not kind:
                    free.append(gap)
                    continue
                keep.append(i)
                if free:
                    seq.append(free.pop())
                    at.append(None)
                else:
                    seq.append(None)
                    at.append(n)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(keep), pa.int32()), pa.array(seq, pa.int64()), pa.array(at, pa.int64()), batch.column("piece").take(pa.array(keep, pa.int64()))], names=schema.fieldNames())
        kind = to_arrow_schema(schema).field("piece").type
        for i in range(0, len(free), 10_000):
            own = free[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64()), pa.array(range(i, i + len(own)), pa.int64()), pa.nulls(len(own), kind)], names=schema.fieldNames())

    return rows.select("kind", "seq", "piece").mapInArrow(run, schema)


def _settled(swept: DataFrame) -> DataFrame:
    """What partitions left over, matched across them by rank: (piece, seq, level); without seq, pieces for which there is no gap.

    Gaps and pieces are brackets: over all partitions in order, a gap opens one more level and a piece closes the last. On a
    level they alternate, so a piece takes the gap before it on its level, which has a row or two of each partition.
    Pieces without one have the levels 0, -1, -2, ... by falling length.
    """
    left = swept.where("at is not null").withColumn("gap", F.col("piece").isNull())
    # One row for each partition.
    sums = left.groupBy("part").agg(F.count_if("gap").alias("gaps"), F.count_if(~F.col("gap")).alias("pieces"))
    before = F.sum(F.col("gaps") - F.col("pieces")).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("part", "pieces", F.coalesce(before, F.lit(0)).alias("height"))
    level = F.when(F.col("gap"), F.col("height") - F.col("pieces") + F.col("at") + 1).otherwise(F.col("height") - F.col("at"))
    ranked = left.join(F.broadcast(sums), "part").withColumn("level", level)
    last = F.lag("seq").over(Window.partitionBy("level").orderBy("part", "gap"))
    return ranked.withColumn("took", last).where(~F.col("gap")).select("piece", F.col("took").alias("seq"), "level")


def _opened(alone: DataFrame, max_tokens: int, number: int) -> DataFrame:
    """Pieces without a gap, by level, put into new sequences of as many pieces as fit by their length: (piece, seq)."""
    fit = alone.withColumns({"rank": -F.col("level"), "k": F.expr(f"{max_tokens} div piece.length")})
    # One row for each number of pieces, at most max_tokens. A sequence that a longer length began goes on into the next.
    kinds = fit.groupBy("k").agg(F.min("rank").alias("start"), F.max("rank").alias("last"))
    begin = F.struct(F.lit(0).cast("long").alias("next"), F.lit(0).cast("long").alias("base"), F.array().cast("array<struct<k:bigint,from:bigint,base:bigint>>").alias("found"))

    def step(done: Column, x: Column) -> Column:
        at = F.greatest(done["next"], x["start"])
        more = F.greatest(F.lit(0).cast("long"), F.ceil((x["last"] + 1 - at) / x["k"]))
        mine = F.struct(x["k"].cast("long").alias("k"), at.alias("from"), done["base"].alias("base"))
        return F.struct((at + more * x["k"]).cast("long").alias("next"), (done["base"] + more).alias("base"), F.concat(done["found"], F.array(mine)).alias("found"))

    runs = kinds.agg(F.aggregate(F.array_sort(F.collect_list(F.struct("k", "start", "last"))), begin, step)["found"].alias("runs")).select(F.inline("runs"))
    nth = F.expr("base + if(rank < from, -1, (rank - from) div k)")
    return fit.join(F.broadcast(runs), "k").select("piece", (nth * _ROUNDS + number).cast("long").alias("seq"))


def best_fit(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The pieces (any columns, with ``length``) with sequence_id and offset."""
    names = pieces.columns
    held = ops.cut(pieces.select(F.struct(*names).alias("piece"), F.monotonically_increasing_id().alias("key")))
    size = F.col("piece.length")
    # At most max_tokens rows: where rounds begin and end, and how many partitions they take.
    sizes = {r["n"]: r["count"] for r in held.groupBy(size.alias("n")).count().collect()}
    full = held.where(size == max_tokens).select("piece.*", (F.col("key") * _ROUNDS).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    gaps, placed, done = None, None, 0
    for number, (low, high) in enumerate(bands((n for n in sizes if n < max_tokens), max_tokens), 1):
        mine = held.where((size >= low) & (size <= high))
        rows = mine.select(size.alias("size"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), "piece", "key")
        if gaps is not None:
            # A gap that holds several of the longest pieces takes part as that many, of equal size.
            parts = F.greatest(F.lit(1), F.expr(f"room div {high}"))
            split = gaps.where(F.col("room") >= low).select("seq", F.expr("room").alias("room"), parts.alias("parts"))
            split = split.select((F.expr("room div parts")).alias("size"), F.lit(0).alias("kind"), "seq", F.lit(None).cast(rows.schema["piece"].dataType).alias("piece"), F.explode(F.sequence(F.lit(1), F.col("parts").cast("int"))).alias("nth"))
            rows = rows.unionByName(split.select("size", "kind", "seq", "piece", F.xxhash64("seq", "nth").alias("key")))
        n = sum(sizes[i] for i in range(low, high + 1) if i in sizes)
        order = [F.desc("size"), F.asc("kind"), F.asc("key")]
        swept = ops.cut(_sweep(rows.repartitionByRange((n + done) // ROWS_A_PART + 1, *order).sortWithinPartitions(*order)))
        done += n
        settled = _settled(swept)
        opened = _opened(settled.where("seq is null"), max_tokens, number).withColumn("new", F.lit(max_tokens))
        rest = ops.cut(settled.where("seq is not null").select("piece", "seq", F.lit(0).alias("new")).unionByName(opened))
        both = swept.where("at is null").select("piece", "seq", F.lit(0).alias("new")).unionByName(rest)
        placed = both if placed is None else placed.unionByName(both)
        change = both.select("seq", (-F.col("piece.length")).alias("room"), "new")
        if gaps is not None:
            change = change.unionByName(gaps.withColumn("new", F.lit(0)))
        if low > 1:
            gaps = ops.cut(change.groupBy("seq").agg((F.sum("room") + F.max("new")).alias("room")).where("room > 0"))
    if placed is None:
        return full
    # At most max_tokens pieces share a sequence.
    before = F.sum("piece.length").over(Window.partitionBy("seq").orderBy(F.desc("piece.length"), "piece")) - F.col("piece.length")
    rest = placed.select("piece.*", F.col("seq").alias("sequence_id"), before.alias("offset"))
    return full.unionByName(rest)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return best_fit(tokenize(docs, id_col=id_col, text_col=text_col, max_tokens=max_tokens, end_id=end_id, tokenizer=tokenizer, with_ids=with_ids), max_tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids; a sequence has at most max_tokens pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over documents."""
    return pack(ops.read(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def brute_force_pieces(docs: list[tuple], encode: Callable[[str], list[int]], max_tokens: int = MAX_TOKENS) -> list[tuple]:
    """Plain Python version of the cutting for tests: (doc_id, piece, start, length, ids_crc32)."""
    out = []
    for doc, text in docs:
        ids = [*encode(text or ""), END_ID]
        first = len(ids) % max_tokens or max_tokens
        cuts = [0, *range(first, len(ids) + 1, max_tokens)]
        for i in range(len(cuts) - 1):
            own = ids[cuts[i] : cuts[i + 1]]
            out.append((doc, i, cuts[i], len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))))
    return out
