"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers read the same bytes (a space and the text). A shared cut is a place where a token of each ends. An
interval of tokens looks for a cut near its middle: the middle token's end is sought among the other side's ends by
bisection, then its neighbours', further and further out; the interval is divided at the nearest one found, and both
halves go on. An interval without a cut is a leaf: a group. All intervals of a slice of texts take a step at once.

Links are counted over the whole corpus. A slice of texts (a block) writes one row: its documents' counts and hashes, each
distinct pair of linked ids with its number of links, and for each document which of these pairs it has how often.
The blocks' pairs are added up by pair; a second join brings each block the corpus-wide counts of its pairs, from which its documents'
sums follow. So what is shuffled are a block's distinct pairs, texts are tokenised once and no table of pairs is broadcast.

Defined results: a text that is null or empty, or that either tokenizer doesn't give back byte for byte, has no tokens,
zeros and an empty hash; special tokens' strings are plain text; repeated rows each count, in links too; null ids are kept;
an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.llm import textops as ops
from factloom.llm.packing import Tokens

BLOCK_BYTES = 2 << 20
#: Fixed value: the mark of a space in pieces.
_SPACE = "▁"
_SIDES: dict[tuple[str, str], tuple[ByteTokens, PieceTokens]] = {}


def default_tokenizers() -> tuple[str, str]:
    """The vocabulary files; the package has the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class _Vocabulary:
    """The tokens' bytes: lengths, and the bytes themselves by id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)

    def says(self, ids: np.ndarray, data: bytes) -> bool:
        """Whether the tokens' bytes, joined, are ``data``."""
        return int(self.length[ids].sum()) == len(data) and b"".join(map(self.tokens.__getitem__, ids.tolist())) == data


class ByteTokens(Tokens, _Vocabulary):
    """A byte-level vocabulary; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        Tokens.__init__(self, path)
        self.own.encode_special_tokens = True
        self.special = []
        # Printable bytes show as themselves, the others as the characters from 256 on.
        shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        names = [self.own.id_to_token(i) or "" for i in range(self.own.get_vocab_size())]
        _Vocabulary.__init__(self, [bytes(map(byte_of.__getitem__, t)) for t in names])

    def of(self, text: str) -> np.ndarray:
        return np.frombuffer(self.ids(" " + text), "<u4").astype(np.int64)


class PieceTokens(_Vocabulary):
    """A vocabulary of pieces with bytes to fall back on; it puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)])

    def of(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text), np.int64)


def _sides(paths: tuple[str, str]) -> tuple[ByteTokens, PieceTokens]:
    if paths not in _SIDES:
        _SIDES[paths] = ByteTokens(paths[0]), PieceTokens(paths[1])
    return _SIDES[paths]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., start[1], ...: ``length`` numbers each."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


def _near_middle(low: np.ndarray, high: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each interval of tokens low .. high - 1 the one nearest to its middle whose end is among ``other``, or -1."""
    middle = (low + high) // 2
    found = np.where(other[np.searchsorted(other, ends[middle])] == ends[middle], middle, -1)
    still, reach, width = np.flatnonzero(found < 0), 1, 1
    while len(still):
        m, lo, hi = middle[still], low[still], high[still]
        right, left = np.minimum(m + reach, hi), np.maximum(m - reach - width + 1, lo)
        n_right, n_left = np.minimum(m + reach + width, hi) - right, np.maximum(m - reach + 1 - left, 0)
        at = np.concatenate([_ranges(right, n_right), _ranges(left, n_left)])
        own = np.concatenate([np.repeat(np.arange(len(still)), n_right), np.repeat(np.arange(len(still)), n_left)])
        hit = np.flatnonzero(other[np.searchsorted(other, ends[at])] == ends[at])
        # The nearest comes last, and so stays.
        hit = hit[np.argsort(-np.abs(at[hit] - m[own[hit]]), kind="stable")]
        found[still[own[hit]]] = at[hit]
        reach += width
        still = still[(found[still] < 0) & ((m + reach < hi) | (m - reach >= lo))]
        width *= 2
    return found


def shared_cuts(ends: np.ndarray, ptr: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which tokens end where a token of the other side ends; ends rise through all texts, ptr says where a text's tokens begin."""
    cut = np.zeros(len(ends), bool)
    some = np.diff(ptr) > 0
    low, high = ptr[:-1][some], ptr[1:][some] - 1
    cut[high] = True  # both sides end with the text
    while len(low := low[keep := high > low]):
        high = high[keep]
        at = _near_middle(low, high, ends, other)
        low, high, at = low[at >= 0], high[at >= 0], at[at >= 0]
        cut[at] = True
        low, high = np.stack([low, at + 1], axis=1).ravel(), np.stack([at, high], axis=1).ravel()
    return cut


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``most`` in decimal, zero bytes before them, and their lengths."""
    width = len(str(max(most - 1, 0)))
    numbers = np.arange(most)[:, None] // 10 ** np.arange(width - 1, -1, -1)
    out = (numbers % 10 + 48).astype(np.uint8)
    out[:, :-1][numbers[:, :-1] == 0] = 0
    return out, (out > 0).sum(axis=1)


def _spelled(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All groups as text (a1,a2|b1;...;), and each A and B token's place in their order."""
    end_a, end_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    begin_b = np.concatenate([[0], end_b])
    at_a = np.arange(len(a)) + begin_b[np.cumsum(cut_a) - cut_a]
    at_b = np.arange(len(b)) + end_a[np.cumsum(cut_b) - cut_b]
    out = np.zeros((len(a) + len(b), digits.shape[1] + 1), np.uint8)
    out[at_a, :-1], out[at_b, :-1] = digits[a], digits[b]
    out[at_a, -1], out[at_b, -1] = np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))
    return out, at_a, at_b


def _block(texts: list[str | None], sides: tuple[ByteTokens, PieceTokens], digits: np.ndarray, width: np.ndarray) -> dict[str, object]:
    """What a block's row holds beside its place and its ids."""
    ids: list[tuple[np.ndarray, np.ndarray]] = []
    none = np.zeros(0, np.int64)
    for text in texts:
        both = (none, none)
        if text:
            data = b" " + text.encode()
            both = tuple(side.of(text) for side in sides)
            if not all(side.says(own, data) for side, own in zip(sides, both, strict=True)):
                both = (none, none)
        ids.append(both)
    a, b = (np.concatenate([x[i] for x in ids]) if ids else none for i in range(2))
    ptr_a, ptr_b = (np.concatenate([[0], np.cumsum([len(x[i]) for x in ids])]).astype(np.int64) for i in range(2))
    ends_a, ends_b = (np.cumsum(side.length[own]) for side, own in zip(sides, (a, b), strict=True))
    cut_a = shared_cuts(ends_a, ptr_a, ends_b)
    last_a = np.flatnonzero(cut_a)
    last_b = np.searchsorted(ends_b, ends_a[last_a])
    cut_b = np.zeros(len(b), bool)
    cut_b[last_b] = True
    spelled, at_a, at_b = _spelled(a, b, cut_a, cut_b, digits)
    # Bytes before each text's groups: all its digits and a sign for each token.
    size = np.concatenate([[0], np.cumsum(width[a] + 1)])[ptr_a] + np.concatenate([[0], np.cumsum(width[b] + 1)])[ptr_b]
    signs = spelled.ravel()
    signs = signs[signs > 0]
    hashes = [hashlib.sha256(signs[i : j - 1].tobytes()).hexdigest() if j > i else "" for i, j in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
    groups = np.searchsorted(last_a, ptr_a)  # a group's links are one: both its last tokens
    pairs, own, times = np.unique(a[last_a] << 32 | b[last_b], return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(groups))
    used, often = np.unique(doc * max(len(pairs), 1) + own, return_counts=True)
    used_ptr = np.searchsorted(used, np.arange(len(texts) + 1) * max(len(pairs), 1))
    packed = np.concatenate([used % max(len(pairs), 1), often]).astype("<u4").tobytes()
    return {"n_a": np.diff(ptr_a), "n_b": np.diff(ptr_b), "n_groups": np.diff(groups), "groups_sha256": hashes, "pairs": pairs, "times": times, "used_ptr": used_ptr, "used": zstandard.ZstdCompressor(3).compress(packed)}


def _blocks(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str]) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    schema = T._parse_datatype_string(f"block string, ids array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, groups_sha256 array<string>, pairs array<bigint>, times array<bigint>, used_ptr array<bigint>, used binary")
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sides = _sides(paths)
        digits, width = _digits(max(len(s.tokens) for s in sides))
        for i, part in enumerate(ops.text_slices(batches, text_col, BLOCK_BYTES)):
            row = {"block": f"{TaskContext.get().partitionId()}-{i}", "ids": part.column(id_col)} | _block(part.column(text_col).to_pylist(), sides, digits, width)
            columns = [pa.array([row[f.name]], f.type) if f.name in ("block", "used") else pa.ListArray.from_arrays(pa.array([0, len(row[f.name])], pa.int32()), row[f.name] if f.name == "ids" else pa.array(row[f.name], f.type.value_type)) for f in kinds]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return docs.select(*dict.fromkeys([id_col, text_col])).mapInArrow(run, schema)


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each document."""
    ops.bounded(docs.sparkSession)
    blocks = ops.cut(_blocks(docs, id_col, text_col, tokenizers or default_tokenizers()))
    own = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "_")).select("block", "at", "_.pairs", "_.times")
    links = own.groupBy("pairs").agg(F.sum("times").alias("links"))
    # A B id has at most as many pairs as there are A ids.
    most = F.max("links").over(Window.partitionBy(F.col("pairs").bitwiseAND(F.lit((1 << 32) - 1))))
    links = links.withColumn("best", F.col("links") == most)
    told = own.join(links, "pairs").groupBy("block").agg(F.collect_list(F.struct("at", "links", "best")).alias("told"))
    told = told.select(F.col("block").alias("_block"), *(F.col(f"told.{c}").alias(c) for c in ("at", "links", "best")))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string").fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                of: Callable[[str], np.ndarray] = lambda c, row=row: row.column(c).flatten().to_numpy(zero_copy_only=False)
                n = len(of("pairs"))
                links, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
                links[of("at")], best[of("at")] = of("links"), of("best")
                used, often = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.column("used")[0].as_py()), "<u4").astype(np.int64).reshape(2, -1)
                ptr = of("used_ptr")
                sums = [np.concatenate([[0], np.cumsum(v * often)]) for v in (links[used], best[used])]
                count_sum, n_best = (s[ptr[1:]] - s[ptr[:-1]] for s in sums)
                columns = [row.column("ids").flatten(), of("n_a"), of("n_b"), of("n_groups"), of("n_groups"), n_best, count_sum, row.column("groups_sha256").flatten()]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=kinds)

    return blocks.drop("times").join(told, F.col("block") == F.col("_block"), "left").drop("block", "_block", "n_links").mapInArrow(run, schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over documents."""
    return align(ops.read(spark, sf_dir, "documents"))
