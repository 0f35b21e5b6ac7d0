"""Exact substring dedup with super-k-mers: windows that share a minimiser travel as one packed string.

A window is ``k`` consecutive words; its minimiser is the least hash of its ``MINIMISER``-word runs.
Consecutive windows with one minimiser form a packet: their words, joined by single spaces, with the
document's key and the first word's position. Packets go to the bin of their minimiser. There the windows
are sorted by hash, equal neighbours are compared byte for byte, and every window that occurs again sends
its words' range back to its document.

Hot passages: a task first compares its own packets. Of equal ones it settles all their documents at once
and ships a single packet without owner. A first pass counts bytes in fine slots of the minimisers, whose number grows
with the text. Windows in slots that are heavy (``HEAVY_BYTES``, and several times the mean, so that an average slot never
is) take a minimiser of longer runs instead, are counted again, and only what is heavy still ships window by window, dealt
by the window's own hash; so no minimiser gathers in one task, and packets stay packed at any size of corpus. The heavy slots
are a bitmap of at most 2 ** ``MOST_SLOT_BITS`` bits for each level. A bin over its size still merges equal packets as it reads.

Texts longer than ``LONG_BYTES`` are worked through a part at a time.

Defined results: null text has no words (and stays null), texts under ``k`` words lose nothing; documents
are told apart by id and text, so a null or repeated id is no special case, and rows that repeat as a whole
are duplicates of each other; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textops as ops

#: Words of a window; words of the runs whose least hash deals windows, and of those that take over where a slot is heavy.
WINDOW, MINIMISERS = 35, (3, 9)
#: Packed bytes of a fine slot on average, from which their number follows within these bounds.
SLOT_BYTES, LEAST_SLOT_BITS, MOST_SLOT_BITS = 1 << 20, 16, 26
#: Raw bytes of a bin; bytes from which a slot is split, if they are so many times the mean too.
BIN_BYTES, HEAVY_BYTES, HEAVY_TIMES = 16 << 20, 8 << 20, 4
#: Shuffle partitions at most; one takes several bins, one after the other.
MOST_PARTS = 1 << 15
#: Packed bytes that a task compares at once, before it ships; a bin settles a quarter of that at once.
FLUSH_BYTES = 16 << 20
LONG_BYTES = 8 << 20
_COMPARE_BYTES = 1 << 20
_HEAD = np.dtype([("slot", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("word", "<i4"), ("size", "<i4")])


class _Heavy:
    """The heavy slots of a level, a bit for each slot."""

    def __init__(self, bits: int, slots: list[int]):
        self.shift = np.uint64(64 - bits)
        flags = np.zeros(1 << bits, bool)
        flags[slots] = True
        self.packed = np.packbits(flags)

    def has(self, slot: np.ndarray) -> np.ndarray:
        at = (slot >> self.shift).astype(np.int64)
        return (self.packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class _Packets:
    """Packets of some texts: spans in ``raw``, owner text, first word, number of windows, slot hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int, heavy: list[_Heavy], first_word: int = 0, count: bool = False):
        w = ops.Words(data, offsets, ops.WORD_WS)
        self.n = 0
        at = ops.starts_of_runs(w.ptr, k)
        if not len(at):
            return
        self.hashes = w.hashes()
        slot = self._dealt(at, MINIMISERS[0], k)
        which = np.arange(len(at))
        for level, hot in enumerate(heavy, 1):
            which = which[hot.has(slot[which])]
            if not len(which):
                break
            slot[which] = self._dealt(at[which], MINIMISERS[level] if level < len(MINIMISERS) else k, k, level)
        if count and heavy:  # only what the last level deals anew
            at, slot = at[which], slot[which]
            if not len(at):
                return
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (slot[1:] != slot[:-1])
        first = np.flatnonzero(new)
        self.n = len(first)
        self.word = at[first]
        self.windows = np.diff(np.concatenate([first, [len(at)]]))
        self.slot = slot[first]
        self.doc = np.searchsorted(w.ptr, self.word, side="right") - 1
        self.local = self.word - w.ptr[self.doc] + first_word
        keep = ops.WORD_WS[data]
        keep[w.end[w.end < len(keep)]] = 1
        packed = data[keep.astype(bool)]
        packed[ops.WORD_WS[packed] == 0] = 0x20
        # A word that ends its text is followed by the next text's; spans within a text are not affected.
        pos = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
        self.begin, self.stop = pos[w.start], pos[w.end]
        self.raw = packed.tobytes()

    def _dealt(self, at: np.ndarray, m: int, k: int, level: int = 0) -> np.ndarray:
        """The slot hashes of windows ``at`` by the least hash of their runs of m words."""
        m = min(m, k)
        low = ops.sliding_min(ops.sequence_hashes(self.hashes, m), k - m + 1)[at]
        return ops.mixed(low ^ np.uint64(level))

    def spans(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.begin[self.word], self.stop[self.word + self.windows + k - 2]


def _parts(batches, column: str, k: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Slices with their texts (bytes, offsets, number of the first word); a text of over ``most`` bytes comes in parts that share k - 1 words."""
    for part in ops.text_slices(batches, column, min(most, ops.SLICE_BYTES)):
        data, offsets = ops.text_buffers(part.column(column))
        at, word, size = 0, 0, most
        while len(data) - at > most and part.num_rows == 1:
            stop = ops.word_break(data, at + size)
            if stop == len(data):
                break
            own = ops.Words(data[at:stop], np.array([0, stop - at]), ops.WORD_WS).start
            if len(own) < k:
                size *= 2
                continue
            yield part, data[at:stop], np.array([0, stop - at]), word
            word += len(own) - k + 1
            at, size = at + int(own[len(own) - k + 1]) if k > 1 else stop, most
        yield part, data[at:], offsets if not at else np.array([0, len(data) - at]), word


def _merged(packets: list[tuple[bytes, int, int, int, int]], done: list[tuple[int, int, int, int]]) -> list[tuple[bytes, int, int, int, int]]:
    """One packet for each text: of equal ones all owners' words go to ``done``, and one without owner stays (word -1)."""
    held: dict[bytes, tuple[int, int, int, int] | None] = {}
    for text, *owner in packets:
        if text not in held:
            held[text] = tuple(owner)
            continue
        was = held[text]
        n = 0
        for slot, k1, k2, word in (was, owner) if was is not None and was[3] >= 0 else (owner,):
            if word >= 0:
                n = n or text.count(b" ") + 1
                done.append((k1, k2, word, word + n))
        held[text] = (owner[0], 0, 0, -1)
    return [(t, *o) for t, o in held.items()]


def _doubled(packets: list[tuple[bytes, int, int, int, int]], k: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of words covered by windows that occur again among these packets (all of their slots)."""
    texts = [p[0] for p in packets]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    w = ops.Words(data, np.concatenate([[0], np.cumsum(size)]), ops.WORD_WS)
    at = ops.starts_of_runs(w.ptr, k)
    h = ops.sequence_hashes(w.hashes(), k)[at]
    order = np.argsort(h, kind="stable")
    h = h[order]
    alike = np.flatnonzero(h[1:] == h[:-1])
    doc = w.doc()[at]
    word = np.fromiter((p[4] for p in packets), np.int64, len(packets))
    again = np.zeros(len(at), bool)
    # Compare the bytes of neighbours of one hash, about a megabyte at a time.
    begin, length = w.start[at], w.end[at + k - 1] - w.start[at]
    sure = np.zeros(len(alike), bool)
    load = np.cumsum(length[order[alike]])
    i = 0
    while i < len(alike):
        j = max(i + 1, int(np.searchsorted(load, (load[i - 1] if i else 0) + _COMPARE_BYTES, side="right")))
        x, y = order[alike[i:j]], order[alike[i:j] + 1]
        ok = length[x] == length[y]
        n = length[x] * ok
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = data[np.repeat(begin[x], n) + step] == data[np.repeat(begin[y], n) + step]
        bad = np.zeros(len(x), bool)
        bad[np.repeat(np.arange(len(x)), n)[~same]] = True
        sure[i:j] = ok & ~bad
        i = j
    pairs = alike[sure]
    again[order[pairs]] = True
    again[order[pairs + 1]] = True
    # Different windows of one hash: such a run of equal hashes is told apart by its texts.
    if not sure.all():
        raw = data.tobytes()
        for value in np.unique(h[alike[~sure]]).tolist():
            run = order[np.searchsorted(h, value) : np.searchsorted(h, value, side="right")].tolist()
            by: dict[bytes, list[int]] = {}
            for j in run:
                by.setdefault(raw[begin[j] : begin[j] + length[j]], []).append(j)
            for group in by.values():
                again[group] = len(group) > 1
    # A window of a packet without owner stands for several, so its equals are doubled: they pair with it anyhow.
    again &= word[doc] >= 0
    hit = np.flatnonzero(again)
    if not len(hit):
        return
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (doc[hit[1:]] != doc[hit[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(hit)]]) - 1
    for a, b in zip(hit[first].tolist(), hit[last].tolist(), strict=True):
        p = packets[doc[a]]
        start = p[4] + int(at[a] - w.ptr[doc[a]])
        yield p[2], p[3], start, start + b - a + k


_RANGES = "k1 bigint, k2 bigint, first int, past int"


def _range_batch(done: list[tuple[int, int, int, int]]) -> dict[str, pa.Array]:
    cols = list(zip(*done, strict=True)) if done else [[], [], [], []]
    return {n: pa.array(c, t) for n, c, t in zip(("k1", "k2", "first", "past"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)}


def _slot_bytes(keyed: DataFrame, column: str, k: int, bits: int, heavy: list[_Heavy]) -> DataFrame:
    """(slot, bytes) of the packets that the last level of ``heavy`` deals, of equal ones in a slice only the first."""
    sent = keyed.sparkSession.sparkContext.broadcast(heavy)

    def count(batches):
        held, total, have = [], [], 0

        def merged():
            slot, at = np.unique(np.concatenate(held), return_inverse=True)
            return slot, np.bincount(at, np.concatenate(total), len(slot)).astype(np.int64)

        def given(slot, size):
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(size)], names=["slot", "bytes"])

        for _, data, offsets, word in _parts(batches, column, k, LONG_BYTES):
            p = _Packets(data, offsets, k, sent.value, word, True)
            if not p.n:
                continue
            a, b = p.spans(k)
            size = b - a
            _, one = np.unique(p.slot ^ ops.mixed(p.hashes[p.word + p.windows + k - 2]) ^ size.astype(np.uint64), return_index=True)
            held.append((p.slot[one] >> np.uint64(64 - bits)).astype(np.int64))
            total.append(size[one])
            have += len(one)
            if have > 1 << 20:
                slot, size = merged()
                held, total, have = [slot], [size], len(slot)
                if have > 1 << 19:  # as good as all different: the shuffle sums up the rest
                    yield given(slot, size)
                    held, total, have = [], [], 0
        if held:
            yield given(*merged())

    return keyed.select(column).mapInArrow(count, "slot bigint, bytes bigint").groupBy("slot").agg(F.sum("bytes").alias("bytes"))


def _split_slots(keyed: DataFrame, text_col: str, k: int) -> tuple[int, list[_Heavy]]:
    """Packed bytes of all packets, and the heavy slots by level."""
    text = keyed.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(max(LEAST_SLOT_BITS, (3 * text // SLOT_BYTES).bit_length()), MOST_SLOT_BITS)
    heavy: list[_Heavy] = []
    total = 0
    for _ in MINIMISERS:
        slots = ops.cut(_slot_bytes(keyed, text_col, k, bits, heavy))
        found = slots.agg(F.sum("bytes")).first()[0] or 0
        total = total or found
        # At most a HEAVY_TIMES-th of the slots.
        least = max(HEAVY_BYTES, HEAVY_TIMES * total >> bits)
        hot = slots.where(F.col("bytes") > least).select("slot").toArrow().column(0).to_numpy()
        if not len(hot):
            break
        heavy.append(_Heavy(bits, hot))
    return total, heavy


def repeated_ranges(keyed: DataFrame, text_col: str, k: int = WINDOW) -> DataFrame:
    """(k1, k2, first, past) ranges of words covered by windows that start anywhere else too; may overlap."""
    return matched(shipped(keyed, text_col, k), k)


def shipped(keyed: DataFrame, text_col: str, k: int = WINDOW) -> tuple[DataFrame, int]:
    """Packets by bin (bin int, blob binary) with ranges that are settled where they were made; and the number of bins."""
    spark = keyed.sparkSession
    ops.bounded(spark)
    total, heavy = _split_slots(keyed, text_col, k)
    n_bins = total // BIN_BYTES + 12
    sent = spark.sparkContext.broadcast(heavy)

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        held: list[tuple[bytes, int, int, int, int]] = []
        size = 0

        def flush():
            done: list[tuple[int, int, int, int]] = []
            packets = _merged(held, done)
            head = np.array([(p[1], p[2], p[3], p[4], len(p[0])) for p in packets], _HEAD)
            bins = (head["slot"] % np.uint64(n_bins)).astype(np.int64)
            order = np.argsort(bins, kind="stable")
            cuts = np.flatnonzero(np.diff(bins[order])) + 1
            keys, blobs = [], []
            for group in np.split(order, cuts):
                if len(group):
                    keys.append(int(bins[group[0]]))
                    blobs.append(press.compress(len(group).to_bytes(4, "little") + head[group].tobytes() + b"".join(packets[i][0] for i in group.tolist())))
            r = _range_batch(done)
            n = len(done)
            # Ranges that are settled here ride along to any bin.
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary()), *(pa.nulls(len(keys), v.type) for v in r.values())], names=["bin", "blob", *r])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array((np.arange(n) % n_bins).astype(np.int32)), pa.nulls(n, pa.binary()), *r.values()], names=["bin", "blob", *r])

        for part, data, offsets, word in _parts(batches, text_col, k, LONG_BYTES):
            p = _Packets(data, offsets, k, sent.value, word)
            if not p.n:
                continue
            a, b = p.spans(k)
            k1, k2 = part.column("k1").to_numpy()[p.doc], part.column("k2").to_numpy()[p.doc]
            held += zip(map(p.raw.__getitem__, map(slice, a.tolist(), b.tolist())), p.slot.tolist(), k1.tolist(), k2.tolist(), p.local.tolist(), strict=True)
            size += int((b - a).sum())
            if size > FLUSH_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return keyed.select("k1", "k2", text_col).mapInArrow(pack, f"bin int, blob binary, {_RANGES}"), n_bins


def matched(packets: tuple[DataFrame, int], k: int = WINDOW) -> DataFrame:
    """The ranges of windows that occur again, bin by bin."""
    sent, n_bins = packets

    def match(batches):
        open_ = zstandard.ZstdDecompressor()

        def found(packets):
            done: list[tuple[int, int, int, int]] = []
            one = _merged(packets, done)
            done += _doubled(one, k)
            r = _range_batch(done)
            return pa.RecordBatch.from_arrays(list(r.values()), names=list(r))

        def settle(packets):
            """A bin's packets, some slots at a time."""
            packets.sort(key=lambda p: p[1])
            group, size = [], 0
            for p in packets:
                if size > FLUSH_BYTES // 4 and p[1] != group[-1][1]:
                    yield found(group)
                    group, size = [], 0
                group.append(p)
                size += len(p[0])
            if group:
                yield found(group)

        key, held, size, limit = None, [], 0, 2 * BIN_BYTES
        for batch in batches:
            ranges = batch.filter(pa.compute.is_null(batch.column("blob")))
            if ranges.num_rows:
                yield ranges.select(["k1", "k2", "first", "past"])
            for b, blob in zip(batch.column("bin").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if b != key:
                    if held:
                        yield from settle(held)
                    key, held, size, limit = b, [], 0, 2 * BIN_BYTES
                if blob is None:
                    continue
                raw = open_.decompress(blob)
                n = int.from_bytes(raw[:4], "little")
                head = np.frombuffer(raw, _HEAD, n, 4)
                end = 4 + n * _HEAD.itemsize + np.cumsum(head["size"], dtype=np.int64)
                held += zip(map(raw.__getitem__, map(slice, (end - head["size"]).tolist(), end.tolist())), *(head[c].tolist() for c in ("slot", "k1", "k2", "word")), strict=True)
                size += int(head["size"].sum(dtype=np.int64))
                if size > limit:
                    done: list[tuple[int, int, int, int]] = []
                    held = _merged(held, done)
                    size = sum(len(p[0]) for p in held)
                    limit = max(limit, 2 * size)
                    r = _range_batch(done)
                    yield pa.RecordBatch.from_arrays(list(r.values()), names=list(r))
        if held:
            yield from settle(held)

    return sent.repartition(min(n_bins, MOST_PARTS), "bin").sortWithinPartitions("bin").mapInArrow(match, _RANGES)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """128 bits that tell a document by its id and text."""
    return docs.withColumns({"k1": F.xxhash64(F.lit(1), id_col, text_col), "k2": F.xxhash64(F.lit(2), text_col, id_col)})


def _long_kept(text: bytes, first: list[int], past: list[int], most: int) -> tuple[int, int, bytes]:
    """Words, words removed, and the words left joined by one space, of a long text, a part at a time."""
    data = np.frombuffer(text, np.uint8)
    edges, reach = np.array(sorted(first), np.int64), np.maximum.accumulate(np.array([b for _, b in sorted(zip(first, past, strict=True))], np.int64)) if first else np.zeros(0, np.int64)
    at, n, removed, out = 0, 0, 0, []
    while at < len(data):
        stop = ops.word_break(data, at + most)
        own = np.append(data[at:stop], np.uint8(0x20))
        w = ops.Words(own, np.array([0, len(own)]), ops.WORD_WS)
        word = n + np.arange(len(w.start))
        run = np.searchsorted(edges, word, side="right")
        gone = (run > 0) & (np.append(0, reach)[run] > word)
        step = np.zeros(len(own) + 1, np.int8)
        np.add.at(step, w.start[~gone], 1)
        np.add.at(step, w.end[~gone] + 1, -1)
        body = own[np.cumsum(step[:-1]) > 0]
        body[ops.WORD_WS[body] == 0] = 0x20
        out.append(body.tobytes())
        at, n, removed = stop, n + len(word), removed + int(gone.sum())
    return n, removed, b"".join(out).rstrip(b" ")


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (default: all) with n_words, n_removed and kept.

    ``kept`` has the words left, joined by one space, if any were removed; else the text as it is.
    """
    names = docs.columns if keep is None else keep
    slim = docs.select(*dict.fromkeys([id_col, text_col, *names]))
    inner = slim.select(F.struct(*(c for c in slim.columns if c != text_col)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = _keyed(inner, "id", "text")
    ranges = repeated_ranges(keyed, "text", k).distinct()
    spans = ranges.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("first", "past"))).alias("spans"))
    joined = keyed.drop("id").join(spans, ["k1", "k2"], "left").select("row", "text", F.col("spans.first").alias("first"), F.col("spans.past").alias("past"))

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            n_words, n_removed, kept = [], [], []
            for text, first, past in zip(batch.column("text").to_pylist(), batch.column("first").to_pylist(), batch.column("past").to_pylist(), strict=True):
                if text is not None and len(text) > LONG_BYTES:
                    n, gone, left = _long_kept(text.encode(), first or [], past or [], LONG_BYTES)
                    n_words.append(n)
                    n_removed.append(gone)
                    kept.append(left.decode() if gone else text)
                    continue
                words = (text or "").encode().split()
                n_words.append(len(words))
                left, at = text, 0
                if first:
                    parts: list[bytes] = []
                    for a, b in zip(first, past, strict=True):
                        parts += words[at:a] if a > at else []
                        at = max(at, b)
                    parts += words[at:]
                    n_removed.append(len(words) - len(parts))
                    left = b" ".join(parts).decode()
                else:
                    n_removed.append(0)
                kept.append(left)
            return {"n_words": n_words, "n_removed": n_removed, "kept": kept}

        return work

    out = ops.map_text(joined, "text", make, [("n_words", "bigint"), ("n_removed", "bigint"), ("kept", "string")], ["row", *(["text"] if text_col in names else [])], need=("first", "past"))
    own = (F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names if c not in ("n_words", "n_removed", "kept"))
    return out.select(*own, "n_words", "n_removed", "kept")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over documents."""
    found = substring_dedup(ops.read(spark, sf_dir, "documents"), keep=["doc_id"])
    # Words are split at ASCII white space, so the digest joins them with single spaces.
    text = F.trim(F.regexp_replace(F.coalesce("kept", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
p as (select rid, i, words[i] as word, case when i + 34 <= len(words) then array_to_string(words[i:i + 34], ' ') end as win from d, unnest(range(1, len(words) + 1)) as t(i)),
twice as (select win from p where win is not null group by win having count(*) > 1),
m as (select rid, i, word, max(case when twice.win is not null then 1 else 0 end) over (partition by rid order by i rows between 34 preceding and current row) as gone from p left join twice on p.win = twice.win),
k as (select rid, cast(sum(gone) as bigint) as n_removed, string_agg(word, ' ' order by i) filter (gone = 0) as kept from m group by rid)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (rid)"""


def brute_force(docs: list[tuple], k: int = WINDOW) -> list[tuple]:
    """Plain Python version for tests: (doc_id, n_words, n_removed, kept_sha256) per row."""
    import re
    from collections import Counter

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
