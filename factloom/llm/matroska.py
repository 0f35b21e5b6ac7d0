"""Matroska media columns: write samples to a file in a binary column, parse files to packet tables.

``mux`` stores bytes as 8-bit mono samples: EBML header, segment information, one track, clusters of
simple blocks with fixed-size lacing, and cues. ``demux`` and ``packets`` parse any Matroska file: elements with
variable-length ids and sizes (unknown sizes of segment and clusters too), block groups and simple blocks, all
four lacings, several tracks, and cues. A file is parsed in one pass over its bytes, without copies of them.

Defined results: a null payload counts as empty; an empty or null file, and bytes that are no Matroska, give no
packets; a truncated last element is read as far as it goes. Equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import textops as ops

FRAME, RATE = 192, 8000
BLOCK_FRAMES, CLUSTER_BLOCKS = 8, 64
FRAME_MS = FRAME * 1000 // RATE

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA1, 0x9B, 0xFB
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
_PARENTS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
#: Elements that end an open cluster or segment of unknown size.
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}


class Packet(NamedTuple):
    track: int
    timestamp: int
    start: int
    size: int
    keyframe: bool
    cluster: int


class Track(NamedTuple):
    number: int
    kind: int
    codec: str
    rate: float
    channels: int
    bits: int
    frame_ns: int


class Media(NamedTuple):
    scale: int
    duration: float
    tracks: list[Track]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]


# -- writing -----------------------------------------------------------------------------------------------------


def _id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size; the all-ones value of a width means unknown, so it takes the next."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, body: bytes) -> bytes:
    return _id(number) + vint(len(body)) + body


def _uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _float(number: int, value: float) -> bytes:
    return element(number, struct.pack(">d", value))


_HEADER = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(0x4282, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_AUDIO = element(AUDIO, _float(SAMPLING_FREQUENCY, RATE) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + _AUDIO))


def write(payload: bytes) -> bytes:
    """A file with the payload as frames of FRAME samples; its length must be a multiple of FRAME."""
    n = len(payload) // FRAME
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, n * FRAME_MS) + element(MUXING_APP, b"factloom") + element(WRITING_APP, b"factloom"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    step = BLOCK_FRAMES * CLUSTER_BLOCKS
    for first in range(0, n, step):
        start = first * FRAME_MS
        body = [_uint(TIMESTAMP, start)]
        for i in range(first, min(first + step, n), BLOCK_FRAMES):
            m = min(BLOCK_FRAMES, n - i)
            lace = struct.pack(">Bh", 0x81, i * FRAME_MS - start) + (b"\x80" if m == 1 else bytes((0x84, m - 1)))
            body.append(element(SIMPLE_BLOCK, lace + payload[i * FRAME : (i + m) * FRAME]))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, start) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        cluster = element(CLUSTER, b"".join(body))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


# -- reading -----------------------------------------------------------------------------------------------------


def _vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int, bool]:
    """Value, place after it, and whether all value bits are ones (unknown size)."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("no variable-length number")
    value = int.from_bytes(data[at : at + width], "big")
    bits = value & (1 << 7 * width) - 1
    return (value if marker else bits), at + width, bits == (1 << 7 * width) - 1


def _laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, size) of each frame of a block whose lacing is ``kind``: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3 and n > 1:
        size, at, _ = _vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            first = at
            value, at, _ = _vint(data, at)
            sizes.append(sizes[-1] + value - ((1 << 7 * (at - first) - 1) - 1))
    if kind == 2:
        sizes = [(end - at) // n] * n
    else:
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError("lacing beyond its block")
        out.append((at, size))
        at += size
    return out


def read(data: bytes | None) -> Media:
    """The tracks, packets and cues of a file; packets in file order, timestamps in units of ``scale`` ns."""
    media = Media(1_000_000, 0.0, [], [], [])
    data = data or b""
    scale, duration, base, cluster_at, segment_at = 1_000_000, 0.0, 0, 0, 0
    track: dict[int, object] = {}
    frames_ns: dict[int, int] = {}
    cue: dict[int, int] = {}
    group: list[int] = []
    stack: list[tuple[int, int]] = []
    at, n = 0, len(data)
    try:
        if _vint(data, 0, True)[0] != EBML:
            return media
        while True:
            while stack and at >= stack[-1][1]:
                kind, _ = stack.pop()
                if kind == TRACK_ENTRY:
                    get = track.get
                    frames_ns[get(TRACK_NUMBER, 0)] = get(DEFAULT_DURATION, 0)
                    media.tracks.append(Track(get(TRACK_NUMBER, 0), get(TRACK_TYPE, 0), get(CODEC_ID, ""), get(SAMPLING_FREQUENCY, 8000.0), get(CHANNELS, 1), get(BIT_DEPTH, 0), get(DEFAULT_DURATION, 0)))
                elif kind == CUE_POSITIONS:
                    media.cues.append((cue.get(CUE_TIME, 0), cue.get(CUE_TRACK, 0), segment_at + cue.get(CUE_CLUSTER, 0)))
                elif kind == BLOCK_GROUP:
                    key = REFERENCE not in group
                    for i in range(group[0] if group else 0, len(media.packets) if group else 0):
                        media.packets[i] = media.packets[i]._replace(keyframe=key)
            if at >= n:
                break
            begin = at
            kind, at, _ = _vint(data, at, True)
            size, at, unknown = _vint(data, at)
            end = n if unknown else min(at + size, n)
            while kind in _TOP and stack and stack[-1][0] == CLUSTER and stack[-1][1] == n and kind != BLOCK_GROUP:
                stack.pop()  # the next top element ends a cluster of unknown size
            if kind in _PARENTS:
                stack.append((kind, end))
                if kind == SEGMENT:
                    segment_at = at
                elif kind == CLUSTER:
                    cluster_at, base = begin, 0
                elif kind == TRACK_ENTRY:
                    track = {}
                elif kind == CUE_POINT:
                    cue = {}
                elif kind == BLOCK_GROUP:
                    group = []
                continue
            if kind in (SIMPLE_BLOCK, BLOCK):
                number, p, _ = _vint(data, at)
                moment = base + int.from_bytes(data[p : p + 2], "big", signed=True)
                flags = data[p + 2]
                if kind == BLOCK:
                    group = [len(media.packets), *group]
                step = frames_ns.get(number, 0) / scale
                for i, (start, length) in enumerate(_laces(data, p + 3, end, flags >> 1 & 3)):
                    media.packets.append(Packet(number, moment + round(i * step), start, length, bool(flags & 0x80), cluster_at))
            elif kind in (TIMESTAMP, TIMESTAMP_SCALE, TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION, CHANNELS, BIT_DEPTH, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                value = int.from_bytes(data[at:end], "big")
                if kind == TIMESTAMP:
                    base = value
                elif kind == TIMESTAMP_SCALE:
                    scale = value or scale
                elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                    cue[kind] = value
                else:
                    track[kind] = value
            elif kind in (SAMPLING_FREQUENCY, DURATION):
                value = struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0] if end > at else 0.0
                if kind == DURATION:
                    duration = value
                else:
                    track[kind] = value
            elif kind == CODEC_ID:
                track[kind] = data[at:end].rstrip(b"\0").decode("ascii", "replace")
            elif kind == REFERENCE:
                group.append(REFERENCE)
            at = end
    except (ValueError, IndexError, struct.error):
        pass  # truncated: what was read before counts
    return media._replace(scale=scale, duration=duration)


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.start : p.start + p.size] for p in sorted((p for p in media.packets if p.track == track), key=lambda p: (p.timestamp, p.start)))


# -- columns -----------------------------------------------------------------------------------------------------


def mux(df: DataFrame, *, payload_col: str, keep: list[str], name: str = "media") -> DataFrame:
    """The columns of ``keep`` and a Matroska file of each text or binary payload, padded with spaces to whole frames."""
    ops.bounded(df.sparkSession)

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            data, offsets = ops.text_buffers(batch.column(payload_col))
            raw, out = data.tobytes(), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                out.append(write(raw[a:b].ljust(max(FRAME, -(-(b - a) // FRAME) * FRAME), b" ")))
            return {name: out}

        return work

    return ops.map_text(df, payload_col, make, [(name, "binary")], keep)


def demux(df: DataFrame, *, media_col: str = "media", keep: list[str]) -> DataFrame:
    """For each file: payload of its first track, and what its packets and samples say (feature)."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            payloads, features = [], []
            for data in batch.column(media_col).to_pylist():
                m = read(data)
                body = payload_of(data or b"", m, m.tracks[0].number if m.tracks else 1)
                s = np.frombuffer(body, np.uint8).astype(np.int16) - 128
                mean = int(s.sum(dtype=np.int64)) // max(1, len(s))
                power = int((s.astype(np.int64) ** 2).sum()) // max(1, len(s))
                level, change = s > mean, 0
                if len(s) > 1:
                    change = int(np.count_nonzero(level[1:] != level[:-1]))
                clusters = len({p.cluster for p in m.packets})
                last = max((p.timestamp for p in m.packets), default=0)
                payloads.append(body)
                features.append(f"packets={len(m.packets)};clusters={clusters};cues={len(m.cues)};last_ms={last * m.scale // 1_000_000};mean={mean};power={power};crossings={change};peak={int(np.abs(s).max()) if len(s) else 0}")
            return {"payload": payloads, "feature": features}

        return work

    return ops.map_text(df, media_col, make, [("payload", "binary"), ("feature", "string")], keep)


def packets(df: DataFrame, *, media_col: str = "media", keep: list[str]) -> DataFrame:
    """The packet table: one row for each packet with track, timestamp_ns, byte_start, byte_length, keyframe, cluster_start, cued."""
    fields = T._parse_datatype_string("track bigint, timestamp_ns bigint, byte_start bigint, byte_length bigint, keyframe boolean, cluster_start bigint, cued boolean").fields
    held = [c for c in keep if c not in {f.name for f in fields}]
    schema = T.StructType([*(df.schema[c] for c in held), *fields])
    ops.bounded(df.sparkSession)

    def run(batches):
        for part in ops.text_slices(batches, media_col):
            rows, out = [], []
            for i, data in enumerate(part.column(media_col).to_pylist()):
                m = read(data)
                cued = {c for _, _, c in m.cues}
                out += [(p.track, p.timestamp * m.scale, p.start, p.size, p.keyframe, p.cluster, p.cluster in cued) for p in m.packets]
                rows += [i] * len(m.packets)
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows, pa.int64())) for c in held), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.fieldNames())

    return df.select(*dict.fromkeys([*held, media_col])).mapInArrow(run, schema)


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over documents: each text is stored, read back and described."""
    docs = ops.read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    stored = mux(docs, payload_col="text", keep=["doc_id", "n_bytes"])
    back = demux(stored, keep=["doc_id", "n_bytes", "media"])
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def brute_force(docs: list[tuple]) -> list[tuple]:
    """What the contract fixes, in plain Python for tests: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32."""
    out = []
    for doc, text in docs:
        raw = (text or "").encode()
        body = raw + b" " * (-len(raw) % 192 if raw else 192)
        out.append((doc, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:])))
    return out
