"""SimHash near-duplicates through a binary trie self-join.

Each text gets a 64-bit fingerprint: bit b is 1 if it is set in over half of the XXH64 values (seed 42) of
its word shingles. Fingerprints that differ in at most ``max_bits`` bits agree in one of ``max_bits + 1`` parts of their
bits, so each distinct fingerprint goes into as many tries, each turned so that another part comes first. A
trie's fingerprints are range-sorted and cut at its nodes into blocks. Blocks that may hold pairs with the same
first part meet in a task (nearly all meet only themselves), which walks both tries together, adds up differing bits and
drops a pair of nodes once the budget is exceeded (or once both lie in one component,
where more links tell nothing new). So a fingerprint is shipped ``max_bits + 1`` times at any size of corpus. Each task
returns a spanning forest of its links; components come from alternating large-star and small-star steps over
those edges, each round checkpointed.

Copies of a fingerprint are one node of the trie, so a group of exact copies of any size costs one entry.
Block descriptors are broadcast: there are at most about ``2 * MAX_BLOCKS`` of them for each trie whatever the input.

Defined results: null or empty text has fingerprint 0 and links like any other; a component's id is its
least id (null only if all its ids are null); repeated rows each get a row; an empty table gives none.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import textops as ops

SHINGLE, MAX_BITS, SEED = 3, 3, 42
BLOCK, MAX_BLOCKS = 8192, 1 << 17
_FRONTIER = 1 << 18


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """The fingerprints of a slice of texts, as int64 with the same bits."""
    lower = ops.LOWER[data]
    w = ops.Words(lower, offsets, ops.WORD_WS)
    n_words = np.diff(w.ptr)
    # The words with one space between them: a word keeps its bytes and one more for the space.
    keep = ops.WORD_WS[lower]
    keep[w.end[w.end < len(keep)]] = 1
    packed = lower[keep.astype(bool)]
    packed[ops.WORD_WS[packed] == 0] = 0x20
    at = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    start, end = at[w.start], at[w.end]
    k = np.minimum(n_words, shingle)
    count = np.where(n_words > 0, n_words - k + 1, 0)
    first = np.repeat(w.ptr[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    last = first + np.repeat(k, count) - 1
    raw = packed.tobytes()
    parts = map(raw.__getitem__, map(slice, start[first].tolist(), end[last].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(first))
    out = np.zeros(len(n_words), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.cumsum(count[some]) - count[some]
        # Sums of up to 255 rows fit a byte; then the sums of those.
        pieces = -(-count[some] // 255)
        p0 = np.cumsum(pieces) - pieces
        cuts = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(p0, pieces))
        sums = np.add.reduceat(np.add.reduceat(bits, cuts, axis=0, dtype=np.uint8).astype(np.int64), p0, axis=0)
        out[some] = np.packbits(2 * sums > count[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """The columns of ``keep`` (default: all) and the fingerprint as a bigint."""
    ops.bounded(docs.sparkSession)

    def make():
        return lambda batch: {name: _fingerprints(*ops.text_buffers(batch.column(text_col)), shingle)}

    return ops.map_text(docs, text_col, make, [(name, "bigint")], docs.columns if keep is None else keep)


def _split(values: np.ndarray, most: int, least_bits: int) -> list[np.ndarray]:
    """Sorted values cut at trie nodes into parts of at most ``most``, each sharing ``least_bits`` leading bits."""
    out, stack = [], [(values, 0)]
    while stack:
        part, depth = stack.pop()
        if not len(part):
            continue
        common = 64 - int(part[0] ^ part[-1]).bit_length()
        if len(part) <= most and common >= least_bits or common == 64:
            out.append(part)
            continue
        shift = np.uint64(63 - max(depth, common))
        at = int(np.searchsorted((part >> shift) & np.uint64(1), 1))
        stack += [(part[at:], common + 1), (part[:at], common + 1)]
    return out


class _Groups:
    """Components of numbered items, joined many links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            rx, ry = self.root[x], self.root[y]
            apart = rx != ry
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            if not len(x):
                return
            np.minimum.at(self.root, np.maximum(rx, ry), np.minimum(rx, ry))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def trie_join(a: np.ndarray, b: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all pairs within ``budget`` differing bits; sorted distinct uint64, b None: a with itself."""
    same = b is None
    other = a if same else b
    shift = 0 if same else len(a)
    groups = _Groups(len(a) + (0 if same else len(b)))
    values = a if same else np.concatenate([a, b])

    def zeros(v: np.ndarray) -> list[np.ndarray]:
        return [np.concatenate([[0], np.cumsum((v >> np.uint64(bit)) & np.uint64(1) == 0)]).astype(np.int32) for bit in range(64)]

    za = zeros(a)
    zb = za if same else zeros(b)
    stack = [(63, np.array([[0, len(a), 0, len(other), 0]], np.int32).T)]
    linked = False
    while stack:
        bit, f = stack.pop()
        if f.shape[1] > _FRONTIER:
            half = f.shape[1] // 2
            stack += [(bit, f[:, half:]), (bit, f[:, :half])]
            continue
        single = (f[1] - f[0] == 1) & (f[3] - f[2] == 1)
        if single.any():
            x, y = f[0][single], f[2][single]
            near = np.bitwise_count(a[x] ^ other[y]) <= budget
            if same:
                near &= x != y
            groups.link(x[near], y[near] + shift)
            linked |= bool(near.any())
            f = f[:, ~single]
        if linked and f.shape[1] > 64:
            change = np.concatenate([[0], np.cumsum(groups.root[1:] != groups.root[:-1])])
            one = (change[f[1] - 1] == change[f[0]]) & (change[f[3] - 1 + shift] == change[f[2] + shift]) & (groups.root[f[0]] == groups.root[f[2] + shift])
            f = f[:, ~one]
        if not f.shape[1] or bit < 0:
            continue
        al, ah, bl, bh, d = f
        am, bm = al + za[bit][ah] - za[bit][al], bl + zb[bit][bh] - zb[bit][bl]
        twin = (al == bl) & (ah == bh) if same else np.zeros(len(al), bool)
        made = []
        for a0, a1, b0, b1, e, ok in ((al, am, bl, bm, 0, True), (am, ah, bm, bh, 0, True), (al, am, bm, bh, 1, True), (am, ah, bl, bm, 1, ~twin)):
            m = (a1 > a0) & (b1 > b0) & (d + e <= budget) & ok
            if m.any():
                made.append(np.stack([a0[m], a1[m], b0[m], b1[m], d[m] + np.int32(e)]))
        if made:
            stack.append((bit - 1, np.concatenate(made, axis=1)))
    child = np.flatnonzero(groups.root != np.arange(len(groups.root)))
    return values[child], values[groups.root[child]]


def _turned(fp: Column, bits: int) -> Column:
    """The 64 bits of a bigint, the first ``bits`` of them put last."""
    return fp if not bits else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def _links(distinct: DataFrame, n: int, max_bits: int) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) whose components are those of all links."""
    spark = distinct.sparkSession
    turns = max_bits + 1
    #: Bits of the part that comes first; the parts of the first turns may be one bit longer, which is left out here.
    part = 64 // turns
    most = max(BLOCK, n // MAX_BLOCKS)
    least = min(part, max(0, (n // most).bit_length() - 1))
    parts = max(1, min(1 << 16, turns * n // (4 * most) + 1))

    def to_blocks(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        turn, values = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
        for t in np.unique(turn).tolist():
            for own in _split(np.sort(values[turn == t].astype(np.int64).view(np.uint64)), most, least):
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([int(own[0].view(np.int64))]), pa.array([int(own[-1].view(np.int64))]), pa.array([own.tobytes()], pa.binary())], names=["turn", "lo", "hi", "data"])

    every = F.explode(F.array(*(F.struct(F.lit(t).alias("turn"), _turned(F.col("fp"), part * t).alias("value")) for t in range(turns)))).alias("x")
    sorted_ = distinct.select(every).select("x.*").repartitionByRange(parts, "turn", "value")
    blocks = ops.cut(sorted_.mapInArrow(to_blocks, "turn int, lo bigint, hi bigint, data binary"))
    ends = blocks.select("turn", "lo", "hi").toPandas()
    turn = ends["turn"].to_numpy()
    lo, hi = (ends[c].to_numpy(np.int64).view(np.uint64) for c in ("lo", "hi"))
    width = np.array([64 - int(x).bit_length() for x in lo ^ hi], np.int64)
    sent = spark.sparkContext.broadcast([(lo[turn == t], width[turn == t]) for t in range(turns)])

    def ship(batches):
        for batch in batches:
            for t, low, high, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                los, widths = sent.value[t]
                me = np.int64(low).view(np.uint64)
                own = 64 - int(me ^ np.int64(high).view(np.uint64)).bit_length()
                shared = np.minimum(widths, own)
                # Bits of the two nodes' places that differ, of those that both nodes fix; none of the first part's may.
                diff = np.where(shared > 0, (los ^ me) >> np.minimum(64 - shared, 63).astype(np.uint64), np.uint64(0))
                first = diff >> np.maximum(shared - part, 0).astype(np.uint64)
                near = np.flatnonzero((first == 0) & (np.bitwise_count(diff) <= max_bits))
                for at in range(0, len(near), 32):  # a few dozen copies of a block at a time
                    q = los[near[at : at + 32]]
                    least_, most_ = np.minimum(q, me).view(np.int64), np.maximum(q, me).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(q), pa.int32()), pa.array(least_), pa.array(most_), pa.array([low] * len(q)), pa.array([data] * len(q), pa.binary())], names=["turn", "a", "b", "side", "data"])

    def join(batches):
        key, first = None, None
        for batch in batches:
            for t, a, b, data in zip(*(batch.column(c).to_pylist() for c in ("turn", "a", "b", "data")), strict=True):
                if a == b:
                    u, v = trie_join(np.frombuffer(data, np.uint64), None, max_bits)
                elif key == (t, a, b):
                    u, v = trie_join(np.frombuffer(first, np.uint64), np.frombuffer(data, np.uint64), max_bits)
                else:
                    key, first = (t, a, b), data
                    continue
                if len(u):
                    back = np.uint64(part * t)
                    u, v = ((x >> back | x << np.uint64(64) - back) if t else x for x in (u, v))
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    tasks = max(12, min(1 << 16, len(lo)))
    met = blocks.mapInArrow(ship, "turn int, a bigint, b bigint, side bigint, data binary")
    return ops.cut(met.repartition(tasks, "turn", "a", "b").sortWithinPartitions("turn", "a", "b").mapInArrow(join, "u bigint, v bigint"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): alternating large-star and small-star steps."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    at = ops.cut(edges.where("u <> v").distinct())
    seen = None
    while True:
        at = ops.cut(star(star(at, True), False))
        now = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _classes(marked: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of ``marked`` (id, fp)."""
    distinct = ops.cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    n = distinct.count()
    roots = components(_links(distinct, n, max_bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("node").isNotNull().alias("linked"))
    # A root has no edge of its own, so group first and join the least ids back only where there are links.
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(low, "root")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, fp (bigint), fingerprint (16 hex digits), component_id."""
    marked = ops.cut(fingerprints(docs, text_col=text_col, keep=[id_col], shingle=shingle))
    classes = _classes(marked, id_col, max_bits)
    return marked.join(classes.select("fp", "component_id"), "fp").select(id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one row of each component: that of the least id, of that id's rows the one of the least
    fingerprint, then of the least hash of the text (one of them, where rows repeat). Extra columns, of any name, ride along.

    Documents are fingerprinted once; they meet their class's survivor by 128 bits of id and text, so a group of copies
    is spread over its ids. Null and empty texts, null ids and empty tables are as in ``near_duplicates``.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.xxhash64(F.lit(1), id_col, text_col).alias("k1"), F.xxhash64(F.lit(2), text_col, id_col).alias("k2"))
    marked = ops.cut(fingerprints(keyed.drop("row"), keep=["id", "k1", "k2"], shingle=shingle))
    classes = _classes(marked, "id", max_bits)
    one = marked.groupBy("fp", "id", "k1", "k2").agg(F.lit(1).alias("one"))
    own = one.join(classes, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    best = own.groupBy("root").agg(F.min(F.struct("fp", "k1", "k2")).alias("best")).select("best.k1", "best.k2")
    won = keyed.select("k1", "k2", "row").join(best, ["k1", "k2"])
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(1)))
    return won.withColumn("rank", rank).where("rank = 1").select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over documents."""
    return near_duplicates(ops.read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def brute_force(docs: list[tuple], max_bits: int = MAX_BITS) -> list[tuple]:
    """Plain Python version for tests: (doc_id, fingerprint, component_id) per row."""
    import re

    fps = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(3, len(words))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), SEED) for i in range(len(words) - k + 1 if k else 0)]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(docs):
        ids = [x for x in (least.get(find(i)), doc) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [(doc, f"{fps[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(docs)]
