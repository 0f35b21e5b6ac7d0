"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions along its bits. Every decision has a context tree over the preceding
bytes, up to ``DEPTH`` of them: a node holds a Krichevsky-Trofimov estimate, and its weighted probability is
half that estimate and half the product over its longer contexts. Contexts that the corpus lacks predict as the
longest one that it has. A text's probability mixes the estimates of
all depths with the weights that the corpus gives them. Texts start after zero bytes and end with byte 0xFF.

Counts of (context, byte) are gathered from all training texts, and every context is kept. Tasks pack the counts
of their texts by shard; a shard holds the contexts that share their last ``SHARED`` bytes, so it works out its part of
the tree on its own. The shorter contexts (at most 256 * 255 + 255 nodes, whatever the corpus) are sums over shards and
go to all of them. The number of shards grows with the text.

Documents are dealt into blocks of about ``BLOCK_BYTES`` and ``BLOCK_ROWS`` by their place. A shard's questions are dealt over tasks by block. A block sends each of its distinct grams (a context and
the next byte) once to its shard and gets its log-probability back, as it does with its distinct words for the base, a
unigram model of words: it sends each once and gets its corpus count.

``fit`` and ``score`` hold a model in memory, for corpora whose model fits a task: ``fit`` keeps, whole, the contexts seen
at least t times, with the least power of two t for which each depth has at most ``MODEL_GRAMS`` pairs, and pools what
rarer contexts saw. ``op2_ctw`` doesn't use them.

Defined results: null counts as empty; an empty text has its end's probability; without training texts all
bits cost one half; repeated rows count and score one by one; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import textops as ops

DEPTH, MODEL_GRAMS = 5, 1 << 20
#: Text and rows of a block; blocks for each of which a shard has one task more.
BLOCK_BYTES, BLOCK_ROWS, BLOCKS_A_SALT = 12 << 20, 100_000, 256
SHARED, BLOCKS_A_SHARD, LEAST_SHARDS = 2, 4, 64
#: Shuffle partitions at most: one takes several blocks or shards, one after the other. Grams that are looked up at once.
MOST_PARTS, AT_ONCE = 1 << 15, 1_000_000
_END = 0xFF
_TABLES: dict[int, tuple] = {}


class Nodes(NamedTuple):
    """The nodes of one depth for one of a byte's eight decisions, sorted by context << 8 | bits so far with a leading one."""

    keys: np.ndarray
    one: np.ndarray
    #: Chance of a one in the pooled rare contexts below, and the weight of stopping here; none at the greatest depth.
    rest: np.ndarray | None
    stop: np.ndarray | None


class Model(NamedTuple):
    depth: int
    levels: list[list[Nodes]]
    #: (context, byte) pairs of the longest contexts, and their log10 probabilities.
    grams: np.ndarray
    log10: np.ndarray


# -- the model ---------------------------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers: Stirling's series from 8 on, the recurrence below."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x + shift


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the estimator's probability of any sequence with a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - math.log(math.pi)


def _nodes(grams: np.ndarray, n: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one decision of (context, byte) counts sorted by gram: keys, zeros, ones."""
    byte = grams & np.uint64(0xFF)
    key = grams >> np.uint64(8) << np.uint64(8) | np.uint64(1 << level) | byte >> np.uint64(8 - level)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    one = np.add.reduceat(n * (byte >> np.uint64(7 - level) & np.uint64(1)).astype(np.int64), first)
    return key[first], np.add.reduceat(n, first) - one, one


def build(by_depth: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of counts by depth: grams (context << 8 | byte, sorted) and how often."""
    depth = len(by_depth) - 1
    levels: list[list[Nodes]] = []
    none = np.zeros(0, np.float32)
    for level in range(8):
        found: list[Nodes] = []
        child = None
        for d in range(depth, -1, -1):
            if not len(by_depth[d][0]):
                found.append(Nodes(np.zeros(0, np.uint64), none, none, none))
                continue
            key, zeros, ones = _nodes(*by_depth[d], level)
            own, one = _log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
            if d == depth:
                found.append(Nodes(key, one.astype(np.float32), None, None))
                child = (key, zeros, ones, own)
                continue
            rest0, rest1, split = zeros.copy(), ones.copy(), np.zeros(len(key))
            if child is not None:
                ckey, c0, c1, below = child
                # A longer context's node belongs to the same bits of the context without its first byte.
                at = np.searchsorted(key, ckey & np.uint64((1 << 8 * (d + 1)) - 1))
                np.subtract.at(rest0, at, c0)
                np.subtract.at(rest1, at, c1)
                np.add.at(split, at, below)
            split += _log_kt(rest0, rest1)
            weighted = np.logaddexp(own, split) - math.log(2)
            stop = np.exp(np.minimum(own - math.log(2) - weighted, 0.0))
            pooled = np.where(rest0 + rest1 > 0, (rest1 + 0.5) / (rest0 + rest1 + 1), one)
            found.append(Nodes(key, one.astype(np.float32), pooled.astype(np.float32), stop.astype(np.float32)))
            child = (key, zeros, ones, weighted)
        levels.append(found[::-1])
    model = Model(depth, levels, np.zeros(0, np.uint64), none)
    grams = by_depth[depth][0]
    logs = [down_the_tree(model, grams[i : i + 100_000]).astype(np.float32) for i in range(0, len(grams), 100_000)]
    return model._replace(grams=grams, log10=np.concatenate(logs) if logs else none)


def down_the_tree(m: Model, grams: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each gram after the bytes before it."""
    contexts = [grams >> np.uint64(8) << np.uint64(8) & np.uint64((1 << 8 * (d + 1)) - 1) for d in range(m.depth + 1)]

    def find(level: int, d: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = m.levels[level][d].keys
        key = contexts[d] | node
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        return at, (keys[at] == key if len(keys) else np.zeros(len(key), bool))

    known = [find(0, d, np.ones(len(grams), np.uint64))[1] for d in range(m.depth + 1)]
    byte, out = grams & np.uint64(0xFF), np.zeros(len(grams))
    for level in range(8):
        node = np.uint64(1 << level) | byte >> np.uint64(8 - level)
        p, longer = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
        for d in range(m.depth, -1, -1):
            own = m.levels[level][d]
            if not len(own.keys):
                continue
            at, there = find(level, d, node)
            one = own.one[at].astype(np.float64)
            if d < m.depth:
                # A longer context that has not come to this decision yet says what this one does.
                inner = np.where(longer, p, np.where(known[d + 1], one, own.rest[at]))
                one = own.stop[at] * one + (1 - own.stop[at]) * inner
            p, longer = np.where(there, one, 0.5), there
        bit = byte >> np.uint64(7 - level) & np.uint64(1)
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


class _Lookup:
    """An open-addressing table of the grams of the longest contexts."""

    def __init__(self, m: Model):
        self.model = m
        bits = max(10, (2 * len(m.grams)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << bits, np.float32)
        left = np.arange(len(m.grams))
        slot = self._slot(m.grams)
        while len(left):
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[slot[free]] = m.grams[left[free]]
            mine = self.keys[slot] == m.grams[left]
            self.values[slot[mine]] = m.log10[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & self.mask

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        slot = self._slot(grams)
        found = self.keys[slot]
        out = self.values[slot]
        left = np.flatnonzero(found != grams)
        missing = []
        while len(left):
            empty = self.keys[slot[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            missing.append(left[empty])
            left = left[~empty]
            slot[left] = (slot[left] + 1) & self.mask
            hit = self.keys[slot[left]] == grams[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit]
        if missing and len(at := np.concatenate(missing)):
            one, back = np.unique(grams[at], return_inverse=True)
            out[at] = np.concatenate([down_the_tree(self.model, one[i : i + 50_000]) for i in range(0, len(one), 50_000)])[back]
        return out


def _sequence(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of a slice of texts with their starts and ends, and each text's range of them."""
    n_docs, size = len(offsets) - 1, np.diff(offsets)
    room = depth + 1
    padded = np.zeros(len(data) + room * n_docs, np.uint8)
    start = offsets[:-1] + room * np.arange(n_docs) + depth
    padded[np.arange(len(data)) + np.repeat(room * np.arange(n_docs) + depth, size)] = data
    padded[start + size] = _END
    if not n_docs:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    wide = padded.astype(np.uint64)
    grams = wide[depth:].copy()
    for i in range(1, depth + 1):
        grams |= wide[depth - i : len(wide) - i] << np.uint64(8 * i)
    # Drop the positions that lie in the next text's lead of zeros.
    keep = np.ones(len(grams), bool)
    lead = (start - depth)[1:]
    for i in range(depth):
        keep[lead + i - depth] = False
    return grams[keep], offsets + np.arange(n_docs + 1)


# -- Spark -------------------------------------------------------------------------------------------------------


def gram_counts(docs: DataFrame, *, text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(gram bigint, n bigint) over all texts: gram is the last ``depth`` bytes and the next."""
    ops.bounded(docs.sparkSession)

    def count(batches):
        held, room, total, times = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merge():
            key, n = np.unique(np.concatenate(held), return_counts=True) if held else (total[:0], times[:0])
            both = np.concatenate([total, key])
            order = np.argsort(both, kind="stable")
            both, counts = both[order], np.concatenate([times, n])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            return both[first], np.add.reduceat(counts, first) if len(first) else counts

        for part in ops.text_slices(batches, text_col):
            grams, _ = _sequence(*ops.text_buffers(part.column(text_col)), depth)
            held.append(grams)
            room += len(grams)
            if room > 4_000_000:
                total, times = merge()
                held, room = [], 0
                if len(total) > 2_000_000:  # a varied corpus: pass on what there is, the shuffle sums it up
                    yield pa.RecordBatch.from_arrays([pa.array(total.view(np.int64)), pa.array(times)], names=["gram", "n"])
                    total, times = total[:0], times[:0]
        total, times = merge()
        for i in range(0, len(total), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(total[i : i + 100_000].view(np.int64)), pa.array(times[i : i + 100_000])], names=["gram", "n"])

    return docs.select(text_col).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, *, text_col: str = "text", depth: int = DEPTH, most: int = MODEL_GRAMS) -> Model:
    """The model of all texts of ``docs``; at most ``most`` (context, byte) pairs of each depth reach the driver."""
    tables = [ops.cut(gram_counts(docs, text_col=text_col, depth=depth))]
    for d in range(depth - 1, -1, -1):  # shorter contexts, each from the next longer ones
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1).cast("long"))
        tables.insert(0, ops.cut(tables[0].groupBy(shorter.alias("gram")).agg(F.sum("n").alias("n"))))
    context = F.shiftright("gram", 8).alias("context")
    seen = [t.groupBy(context).agg(F.sum("n").alias("seen"), F.count("*").alias("pairs")) for t in tables]
    sizes = [{r["power"]: r["pairs"] for r in c.groupBy(F.floor(F.log2("seen")).alias("power")).agg(F.sum("pairs").alias("pairs")).collect()} for c in seen]
    power = 0
    while any(sum(n for p, n in s.items() if p >= power) > most for s in sizes):
        power += 1
    by_depth = []
    for t, c in zip(tables, seen, strict=True):
        kept = t if not power else t.withColumn("context", context).join(c.where(F.col("seen") >= 1 << power).select("context"), "context", "left_semi")
        got = kept.select("gram", "n").toArrow()
        gram, n = (got.column(x).to_numpy() for x in ("gram", "n"))
        order = np.argsort(gram.view(np.uint64), kind="stable")
        by_depth.append((gram[order].view(np.uint64), n[order]))
    return build(by_depth)


# -- the whole tree, in shards -------------------------------------------------------------------------------------


def _squeeze(a: np.ndarray) -> bytes:
    """An array of numbers, its bytes by significance, packed."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueeze(blob: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(blob[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def _summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and their total counts."""
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(n, first) if len(first) else n


def _by_shard(grams: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Each shard that sorted grams meet, and where its grams are."""
    shared = grams >> np.uint64(8) & np.uint64((1 << 8 * SHARED) - 1)
    shard = ((shared * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(8)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    return [(i, order[at[i] : at[i + 1]]) for i in range(shards) if at[i] < at[i + 1]]


def _packed(grams: np.ndarray, shards: int) -> list[tuple[int, np.ndarray, bytes]]:
    """For each shard its part of sorted distinct grams: where they are, and they packed."""
    return [(i, at, _squeeze(np.diff(grams[at], prepend=np.uint64(0)))) for i, at in _by_shard(grams, shards)]


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(_unsqueeze(blob, np.uint64), dtype=np.uint64)


def _distinct(batches, text_col: str, depth: int, most: int | None = None):
    """Distinct grams of texts with their counts; passed on in parts where there are more than ``most``."""
    held, room, total, times = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge():
        key, n = np.unique(np.concatenate([*held, total[:0]]), return_counts=True)
        return _summed(np.concatenate([total, key]), np.concatenate([times, n]))

    for part in ops.text_slices(batches, text_col):
        held.append(_sequence(*ops.text_buffers(part.column(text_col)), depth)[0])
        room += len(held[-1])
        if room > 4_000_000:
            total, times = merge()
            held, room = [], 0
            if most is not None and len(total) > most:  # a varied corpus: the shards sum it up
                yield total, times
                total, times = total[:0], times[:0]
    yield merge()


def shard_counts(docs: DataFrame, shards: int, *, text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(shard int, grams binary, n binary): the counts of all texts, dealt by shard."""
    ops.bounded(docs.sparkSession)

    def count(batches):
        for grams, n in _distinct(batches, text_col, depth, 2_000_000):
            for i, at, blob in _packed(grams, shards):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blob], pa.binary()), pa.array([_squeeze(n[at])], pa.binary())], names=["shard", "grams", "n"])

    return docs.select(text_col).mapInArrow(count, "shard int, grams binary, n binary").repartition(min(shards, MOST_PARTS), "shard")


def _shard_depths(table: pa.Table, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A shard's counts by depth, from SHARED on."""
    none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    grams = np.concatenate([*none[0], *(_unpacked(b) for b in table.column("grams").to_pylist())])
    found = [_summed(grams, np.concatenate([*none[1], *(_unsqueeze(b, np.int64) for b in table.column("n").to_pylist())]))]
    for d in range(depth - 1, SHARED - 1, -1):
        found.insert(0, _summed(found[0][0] & np.uint64((1 << 8 * (d + 1)) - 1), found[0][1]))
    return found


class _Climbed(NamedTuple):
    """Nodes of one decision and depth: keys as in Nodes, zeros, ones, logs of own and of weighted probability."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    own: np.ndarray
    weighted: np.ndarray


def _node(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray | None) -> _Climbed:
    own = _log_kt(zeros, ones)
    return _Climbed(keys, zeros, ones, own, own if split is None else np.logaddexp(own, split) - math.log(2))


def _up(child: _Climbed, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of longer contexts' nodes at depth ``d``: keys, zeros, ones, log of the product of their weighted probabilities."""
    keys, at = np.unique(child.keys & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
    return keys, *(np.bincount(at, x, len(keys)) for x in (child.zeros, child.ones, child.weighted))


def _climb(by_depth: list[tuple[np.ndarray, np.ndarray]], level: int) -> list[_Climbed]:
    """The nodes of one decision in a shard, by depth from SHARED on."""
    found = [_node(*_nodes(*by_depth[-1], level), None)]
    for d in range(SHARED + len(by_depth) - 2, SHARED - 1, -1):
        found.insert(0, _node(*_up(found[0], d)))
    return found


class _Said(NamedTuple):
    """Nodes of one decision and depth: keys, chance of a one where no longer context has the node; what shorter ones and this one put in, and the weight left."""

    keys: np.ndarray
    chance: np.ndarray
    sum: np.ndarray
    left: np.ndarray


def _descend(found: list[_Climbed], d: int, above: _Said | None) -> list[_Said]:
    """Chances of nodes by depth from ``d`` on, below ``above``."""
    out = []
    for d, c in enumerate(found, d):  # noqa: B020
        if above is None:
            sum_, left = np.zeros(len(c.keys)), np.ones(len(c.keys))
        else:
            at = np.searchsorted(above.keys, c.keys & np.uint64((1 << 8 * d) - 1))
            sum_, left = above.sum[at], above.left[at]
        one = (c.ones + 0.5) / (c.zeros + c.ones + 1)
        stop = np.exp(np.minimum(c.own - math.log(2) - c.weighted, 0.0))
        above = _Said(c.keys, sum_ + left * one, sum_ + left * stop * one, left * (1 - stop))
        out.append(above)
    return out


def top(counts: DataFrame, depth: int = DEPTH) -> list[list[_Said]]:
    """For each decision the nodes of the contexts under SHARED bytes, from the sums of all shards: at most 256 * 255 + 255 of them."""

    def sums(table: pa.Table) -> pa.Table:
        by_depth, rows = _shard_depths(table, depth), []
        for level in range(8):
            rows.append(_up(_climb(by_depth, level)[0], SHARED - 1))
        key, zeros, ones, split = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pa.table({"key": key.astype(np.int64), "zeros": zeros.astype(np.int64), "ones": ones.astype(np.int64), "split": split})

    found = counts.groupBy("shard").applyInArrow(sums, "key bigint, zeros bigint, ones bigint, split double")
    got = found.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "split"))).orderBy("key").toArrow()
    key, zeros, ones, split = (got.column(c).to_numpy() for c in ("key", "zeros", "ones", "split"))
    out = []
    for level in range(8):
        mine = (key & 0xFF) >> level == 1
        nodes = [_node(key[mine].astype(np.uint64), zeros[mine], ones[mine], split[mine])]
        for d in range(SHARED - 2, -1, -1):
            nodes.insert(0, _node(*_up(nodes[0], d)))
        out.append(_descend(nodes, 0, None))
    return out


def _log10(grams: np.ndarray, by_depth: list[tuple[np.ndarray, np.ndarray]], tops: list[list[_Said]]) -> np.ndarray:
    """log10 probability of the last byte of each of a shard's grams after the bytes before it."""
    out = np.zeros(len(grams))
    for level in range(8):
        said = [*tops[level]]
        if len(by_depth[-1][0]):
            said += _descend(_climb(by_depth, level), SHARED, said[-1])
        for i in range(0, len(grams), AT_ONCE):
            some = grams[i : i + AT_ONCE]
            byte = some & np.uint64(0xFF)
            node = np.uint64(1 << level) | byte >> np.uint64(8 - level)
            p, left = np.full(len(some), 0.5), np.arange(len(some))
            for d in range(len(said) - 1, -1, -1):  # the longest context that has come to this decision tells
                keys = said[d].keys
                if len(keys):
                    key = some[left] >> np.uint64(8) << np.uint64(8) & np.uint64((1 << 8 * (d + 1)) - 1) | node[left]
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    there = keys[at] == key
                    p[left[there]] = said[d].chance[at[there]]
                    left = left[~there]
            out[i : i + AT_ONCE] += np.log10(np.where(byte >> np.uint64(7 - level) & np.uint64(1) == 1, p, 1 - p))
    return out


def answers(counts: DataFrame, asked: DataFrame, shards: int, depth: int = DEPTH, salts: int = 1) -> DataFrame:
    """(block, grams binary, logs binary) for the rows (shard, block, grams) of ``asked``: log10 probabilities by the whole tree.

    A shard's questions are dealt over ``salts`` tasks, each with a copy of the shard's counts.
    """
    sent = counts.sparkSession.sparkContext.broadcast(top(counts, depth))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = right.column("grams").to_pylist()
        logs = []
        if blobs:
            every, held, room = np.zeros(0, np.uint64), [], 0
            for i, blob in enumerate(blobs, 1):
                held.append(_unpacked(blob))
                room += len(held[-1])
                if room > 4_000_000 or i == len(blobs):
                    every, held, room = np.unique(np.concatenate([every, *held])), [], 0
            value = _log10(every, _shard_depths(left, depth), sent.value).astype(np.float32)
            logs = [_squeeze(value[np.searchsorted(every, _unpacked(b))]) for b in blobs]
        return pa.table({"block": right.column("block"), "grams": pa.array(blobs, pa.binary()), "logs": pa.array(logs, pa.binary())})

    parts = min(shards * salts, MOST_PARTS)
    dealt = asked.withColumn("salt", F.pmod("block", F.lit(salts))).repartition(parts, "shard", "salt")
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(parts, "shard", "salt")
    return copies.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInArrow(answer, "block int, grams binary, logs binary")


# -- a model in memory ------------------------------------------------------------------------------------------------


def _lookup(sent: Broadcast) -> _Lookup:
    """The table of a broadcast model, made once in each worker."""
    if sent.id not in _TABLES:
        _TABLES.clear()
        _TABLES[sent.id] = _Lookup(sent.value)
    return _TABLES[sent.id]


class _Sent:
    """A broadcast with a number that tells it from earlier ones in a reused worker."""

    def __init__(self, spark: SparkSession, model: Model):
        import uuid

        self.id, self._held = uuid.uuid4().hex, spark.sparkContext.broadcast(model)

    @property
    def value(self) -> Model:
        return self._held.value


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (default: all), score (log10 probability) and bits_per_byte (of the text and its end)."""
    spark = docs.sparkSession
    ops.bounded(spark)
    sent, depth = _Sent(spark, model), model.depth

    def make():
        table = _lookup(sent)

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            grams, at = _sequence(*ops.text_buffers(batch.column(text_col)), depth)
            total = np.concatenate([[0.0], np.cumsum(table.log10(grams), dtype=np.float64)])
            s = total[at[1:]] - total[at[:-1]]
            return {"score": s, "bits_per_byte": -s / math.log10(2) / np.diff(at)}

        return work

    return ops.map_text(docs, text_col, make, [("score", "double"), ("bits_per_byte", "double")], docs.columns if keep is None else keep)


def _tokens(text: bytes) -> list[bytes]:
    return [*text.translate(ops.LOWER_TABLE).split(), b""]


def block_scores(docs: DataFrame, *, train_col: str, text_col: str = "text", keep: list[str], text_bytes: int, rows: int, depth: int = DEPTH) -> DataFrame:
    """The columns of ``keep`` with score, bits_per_byte, and n_tokens, n_known, train_tokens, base_score under the unigram model; both models of rows with train_col.

    Texts are shuffled once: the blocks that send their words and grams are the blocks that get the answers. Rows are dealt by
    their place in ``docs``, so that equal rows spread too; ``docs`` must give its rows in one order, as a table or a checkpoint does.
    """
    ops.bounded(docs.sparkSession)
    blocks = max(text_bytes // BLOCK_BYTES, rows // BLOCK_ROWS) + 12
    shards, salts = blocks // BLOCKS_A_SHARD + LEAST_SHARDS, blocks // BLOCKS_A_SALT + 1
    slim = docs.select(*keep, F.col(text_col).alias("_text"), F.col(train_col).alias("_train"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("_block"))
    parts = min(3 * blocks, MOST_PARTS)  # more partitions than blocks, so that few hold several
    slim = slim.repartition(parts, "_block")

    def grams(table: pa.Table) -> pa.Table:
        block, ((found, _),) = table.column("_block")[0].as_py(), _distinct(table.to_batches(), "_text", depth)
        rows = _packed(found, shards)
        return pa.table({"shard": pa.array([i for i, _, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "grams": pa.array([blob for _, _, blob in rows], pa.binary())})

    asked = slim.groupBy("_block").applyInArrow(grams, "shard int, block int, grams binary")
    counts = ops.cut(shard_counts(docs.where(train_col), shards, text_col=text_col, depth=depth))

    def words(table: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        others: set[bytes] = set()
        for text, train in zip(table.column("_text").to_pylist(), table.column("_train").to_pylist(), strict=True):
            if train:
                seen.update(_tokens((text or "").encode()))
            else:
                others.update(_tokens((text or "").encode()))
        others.difference_update(seen)
        block = table.column("_block")[0].as_py()
        n = len(seen) + len(others)
        return pa.table({"block": pa.array([block] * n, pa.int32()), "word": pa.array([*seen, *others], pa.binary()), "n": pa.array([*seen.values(), *([0] * len(others))], pa.int64())})

    from pyspark.sql import Window

    own = slim.groupBy("_block").applyInArrow(words, "block int, word binary, n bigint")
    by_word = Window.partitionBy("word")
    counted = own.select("block", "word", F.sum("n").over(by_word).alias("c"), (F.min("block").over(by_word) == F.col("block")).alias("one"))
    back = counted.unionByName(answers(counts, asked, shards, depth, salts), allowMissingColumns=True).repartition(parts, "block")
    fields = T._parse_datatype_string("score double, bits_per_byte double, n_tokens bigint, n_known bigint, _train_tokens bigint, _distinct bigint, _logs double")
    schema = T.StructType([*(slim.schema[c] for c in keep), *fields])

    def base(left: pa.Table, right: pa.Table) -> pa.Table:
        is_word = right.column("grams").is_null()
        told, right = right.filter(pc.invert(is_word)), right.filter(is_word)
        every = [np.concatenate([f(b) for b in told.column(c).to_pylist()]) for c, f in (("grams", _unpacked), ("logs", lambda b: _unsqueeze(b, np.float32)))]
        table, score, bits = _Lookup(Model(depth, [], *every)), [], []
        for part in ops.text_slices(left.to_batches(), "_text"):
            found, at = _sequence(*ops.text_buffers(part.column("_text")), depth)
            total = np.concatenate([[0.0], np.cumsum(table.log10(found), dtype=np.float64)])
            s = total[at[1:]] - total[at[:-1]]
            score.append(s)
            bits.append(-s / math.log10(2) / np.diff(at))
        del table, told, every
        c = right.column("c").to_numpy()
        logs = np.log10(c + 0.5)
        place = dict(zip(right.column("word").to_pylist(), range(len(c)), strict=True))
        get = place.__getitem__
        n_tokens, n_known, out, mine = [], [], [], []
        for text, train in zip(left.column("_text").to_pylist(), left.column("_train").to_pylist(), strict=True):
            t = _tokens((text or "").encode())
            at = np.fromiter(map(get, t), np.int64, len(t))
            n_tokens.append(len(t))
            n_known.append(int(np.count_nonzero(c[at])))
            out.append(float(logs[at].sum()))
            mine.append(len(t) if train else 0)
        # A word counts as distinct in the first of its blocks, which notes it with its first document.
        distinct = [int(np.count_nonzero((c > 0) & right.column("one").to_numpy(zero_copy_only=False))), *([0] * (len(out) - 1))]
        new = {"n_tokens": n_tokens, "n_known": n_known, "_train_tokens": mine, "_distinct": distinct}
        return pa.table({name: left.column(name) for name in keep} | {"score": pa.array(np.concatenate(score)), "bits_per_byte": pa.array(np.concatenate(bits))} | {k: pa.array(v, pa.int64()) for k, v in new.items()} | {"_logs": pa.array(out, pa.float64())})

    found = ops.cut(slim.groupBy("_block").cogroup(back.groupBy("block")).applyInArrow(base, schema))
    tokens, distinct = found.agg(F.coalesce(F.sum("_train_tokens"), F.lit(0)), F.coalesce(F.sum("_distinct"), F.lit(0))).first()
    each = math.log10(tokens + 0.5 * (distinct + 1))
    return found.select(*keep, "score", "bits_per_byte", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("_logs") - F.col("n_tokens") * each).alias("base_score"))


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over documents."""
    docs = ops.read(spark, sf_dir, "documents").select("doc_id", "text", (ops.id_remainder("doc_id", 5) == 1).alias("held_out"))
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    out = block_scores(docs.withColumn("train", ~F.col("held_out")), train_col="train", keep=["doc_id", "held_out"], text_bytes=size, rows=rows)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def brute_force_score(train: list[str], texts: list[str], depth: int = DEPTH, least: int = 1) -> list[float]:
    """log10 probabilities by the definition, node by node, for tests; contexts seen under ``least`` times are pooled."""
    counts: dict[tuple, list[int]] = {}
    seen: Counter = Counter()

    def steps(text: str):
        data = bytes(depth) + text.encode() + bytes([_END])
        for i in range(depth, len(data)):
            yield data[i - depth : i], data[i]

    for t in train:
        for context, byte in steps(t):
            for d in range(depth + 1):
                s = context[depth - d :]
                seen[s] += 1
                for level in range(8):
                    counts.setdefault((s, 1 << level | byte >> (8 - level)), [0, 0])[byte >> (7 - level) & 1] += 1
    children: dict[bytes, set[bytes]] = {}
    for s in seen:
        if s and seen[s] >= least:
            children.setdefault(s[1:], set()).add(s)

    def kt(n: list[int]) -> float:
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    memory: dict[tuple, tuple] = {}

    def weigh(s: bytes, node: int) -> tuple[float, float, list[int]]:
        """Weighted log-probability, weight of stopping, counts of the pooled rest."""
        if (s, node) not in memory:
            n = counts.get((s, node), [0, 0])
            rest, split = list(n), 0.0
            if len(s) == depth:
                memory[s, node] = (kt(n), 1.0, rest)
            else:
                for c in children.get(s, ()):
                    split += weigh(c, node)[0]
                    for i in (0, 1):
                        rest[i] -= counts.get((c, node), [0, 0])[i]
                split += kt(rest)
                a, b = math.log(0.5) + kt(n), math.log(0.5) + split
                w = max(a, b) + math.log1p(math.exp(-abs(a - b)))
                memory[s, node] = (w, math.exp(a - w), rest)
        return memory[s, node]

    def chance(context: bytes, d: int, node: int) -> float:
        s = context[depth - d :]
        n = counts.get((s, node), [0, 0])
        if not sum(n):
            return 0.5
        here = (n[1] + 0.5) / (sum(n) + 1)
        if d == depth:
            return here
        _, stop, rest = weigh(s, node)
        longer = context[depth - d - 1 :]
        inner = here
        if seen[longer] >= least and sum(counts.get((longer, node), [0, 0])):
            inner = chance(context, d + 1, node)
        elif seen[longer] < least and sum(rest):
            inner = (rest[1] + 0.5) / (sum(rest) + 1)
        return stop * here + (1 - stop) * inner

    out = []
    for t in texts:
        total = 0.0
        for context, byte in steps(t):
            for level in range(8):
                p = chance(context, 0, 1 << level | byte >> (8 - level))
                total += math.log10(p if byte >> (7 - level) & 1 else 1 - p)
        out.append(total)
    return out
