import struct

from factloom.llm import matroska as m


def test_round_trip_and_digests(spark, tmp_path):
    docs = [(1, "short"), (2, None), (3, ""), (4, "x" * 192), (5, "é" * 5000 * 60), (1, "short"), (None, "null id")]
    spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = m.op7_matroska(spark, str(tmp_path)).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=str)
    assert got == sorted(m.brute_force(docs), key=str)
    one = [r for r in rows if r.doc_id == 1]
    assert one[0] == one[1] and all(r.media_bytes > r.payload_bytes for r in rows)


def test_packet_table(spark):
    df = spark.createDataFrame([(1, "a" * 192 * 1100), (2, "b"), (3, None)], "track long, text string")
    stored = m.mux(df.withColumnRenamed("track", "doc"), payload_col="text", keep=["doc"])
    rows = m.packets(stored, keep=["doc"]).orderBy("doc", "timestamp_ns").collect()
    first = [r for r in rows if r.doc == 1]
    assert len(first) == 1100 and [r.timestamp_ns for r in first[:3]] == [0, 24_000_000, 48_000_000]
    assert all(r.byte_length == 192 and r.cued and r.track == 1 for r in rows)
    assert len({r.cluster_start for r in first}) == 3
    assert m.packets(stored.limit(0), keep=["doc"]).count() == 0


def body(track, at, flags, rest):
    return m.vint(track) + struct.pack(">hB", at, flags) + rest


def test_lacings_groups_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 10, b"c" * 500, b"d" * 7]
    whole = b"".join(frames)
    xiph = body(2, 5, 0x02, bytes([3, 255, 45, 10, 255, 245]) + whole)
    ebml = body(2, 6, 0x06, bytes([3]) + m.vint(300, 2) + (-290 + 8191 | 1 << 14).to_bytes(2, "big") + (490 + 8191 | 1 << 14).to_bytes(2, "big") + whole)
    fixed = body(1, 7, 0x84, bytes([1]) + b"xxyy")
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body(1, 8, 0, b"zz")) + m.element(m.REFERENCE, b"\xff"))
    solo = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body(1, 9, 0, b"k")))
    unknown = b"\x01" + b"\xff" * 7
    cluster = m._id(m.CLUSTER) + unknown + m._uint(m.TIMESTAMP, 100)
    blocks = m.element(m.SIMPLE_BLOCK, xiph) + m.element(m.SIMPLE_BLOCK, ebml) + m.element(m.SIMPLE_BLOCK, fixed)
    data = m._HEADER + m._id(m.SEGMENT) + unknown + m._TRACKS + cluster + blocks + cluster.replace(b"\x64", b"\xc8") + m.element(0xEC, b"void") + group + solo
    got = m.read(data)
    assert [data[p.start : p.start + p.size] for p in got.packets] == frames * 2 + [b"xx", b"yy", b"zz", b"k"]
    assert [p.timestamp for p in got.packets] == [105] * 4 + [106] * 4 + [107, 131, 208, 209]
    assert [p.keyframe for p in got.packets[-4:]] == [True, True, False, True]
    assert len({p.cluster for p in got.packets}) == 2 and got.tracks[0].codec == "A_PCM/INT/LIT"


def test_bytes_that_are_no_media():
    for data in (None, b"", b"RIFF....", b"\x1aE\xdf\xa3", b"\x00" * 50):
        assert m.read(data).packets == []
    cut = m.write(b"s" * 192 * 20)
    assert 0 < len(m.read(cut[: len(cut) // 2]).packets) < 20


# -- the stored form and the feature by the format's definition, byte by byte ------------------------------------------


def el(hex_id, body):
    """An element with the shortest size field."""
    n = len(body)
    for width in range(1, 9):
        if n < 2 ** (7 * width) - 1:
            return bytes.fromhex(hex_id) + (n + 2 ** (7 * width)).to_bytes(width, "big") + body
    raise ValueError(n)


def number(hex_id, n):
    return el(hex_id, n.to_bytes(max(1, -(-n.bit_length() // 8)), "big"))


def real(hex_id, x):
    return el(hex_id, struct.pack(">d", x))


def stored(payload):
    """Frames of 192 bytes (24 ms), eight in a block with fixed-size lacing, 64 blocks in a cluster, a cue for each cluster."""
    frames = [payload[i : i + 192] for i in range(0, len(payload), 192)]
    head = el("1a45dfa3", number("4286", 1) + number("42f7", 1) + number("42f2", 4) + number("42f3", 8) + el("4282", b"matroska") + number("4287", 4) + number("4285", 2))
    info = el("1549a966", number("2ad7b1", 10**6) + real("4489", 24.0 * len(frames)) + el("4d80", b"factloom") + el("5741", b"factloom"))
    sound = el("e1", real("b5", 8000.0) + number("9f", 1) + number("6264", 8))
    tracks = el("1654ae6b", el("ae", number("d7", 1) + number("73c5", 1) + number("83", 2) + el("86", b"A_PCM/INT/LIT") + number("23e383", 24_000_000) + sound))
    body, cues = info + tracks, b""
    for c in range(0, len(frames), 512):
        blocks = number("e7", 24 * c)
        for i in range(c, min(c + 512, len(frames)), 8):
            own = frames[i : i + 8]
            lace = b"\x80" if len(own) == 1 else b"\x84" + bytes([len(own) - 1])
            blocks += el("a3", b"\x81" + struct.pack(">h", 24 * (i - c)) + lace + b"".join(own))
        cues += el("bb", number("b3", 24 * c) + el("b7", number("f7", 1) + number("f1", len(body))))
        body += el("1f43b675", blocks)
    return head + el("18538067", body + el("1c53bb6b", cues))


def feature(payload):
    s = [b - 128 for b in payload]
    n, frames = len(s), len(payload) // 192
    mean = sum(s) // n
    crossings = sum((a > mean) != (b > mean) for a, b in zip(s, s[1:], strict=False))
    clusters = -(-frames // 512)
    return f"packets={frames};clusters={clusters};cues={clusters};last_ms={24 * (frames - 1)};mean={mean};power={sum(x * x for x in s) // n};crossings={crossings};peak={max(map(abs, s))}"


def test_stored_form_and_feature(spark, tmp_path):
    import hashlib

    docs = [(1, "short"), (2, None), (3, "y" * 193), (4, "some words, " * 9000), (5, "é\n" * 40_000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in m.op7_matroska(spark, str(tmp_path)).collect():
        raw = (dict(docs)[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = stored(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), feature(payload)), r.doc_id
