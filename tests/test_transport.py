import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.functions import jpeg
from riffle.functions import packing as pk
from riffle.operators import reassembly, transport


def frames(spark, sizes, stream="a"):
    rng = np.random.default_rng(len(sizes))
    return spark.createDataFrame([(stream, i, bytearray(rng.bytes(n))) for i, n in enumerate(sizes)], "stream string, at int, data binary")


def test_streams_come_back_whole(spark):
    sizes = [0, 1, 161, 162, 163, 344, 345, 5000, 70_000]
    rows = frames(spark, sizes).unionByName(frames(spark, sizes[:4], "b"))
    want = {(r.stream, r["at"]): bytes(r.data) for r in rows.collect()}
    for how in ({"tables": "packets", "every": 20}, {"tables": "seconds", "every": 0.1, "rate": 30}, {"media": "h265", "rate": 60}):
        packed = transport.encoded(rows, "stream", "at", "data", **how)
        assert packed.where(F.octet_length("packet") != 188).count() == 0
        got = transport.demuxed(packed, "stream", "at", "sub").collect()
        assert {(r.stream, r.n): bytes(r.data) for r in got} == want and all(r.err is None and r.meta == "" for r in got)
        cc = {}
        for r in packed.orderBy("stream", "at", "sub").collect():
            key, now = (r.stream, r.pid), r.packet[3] & 15
            assert cc.get(key, -1) == -1 and now == 0 or now == (cc[key] + 1) % 16
            cc[key] = now
    raw = transport.raw_media(transport.encoded(rows, "stream", "at", "data"), 256, "stream", "at", "sub").where("stream = 'a'").first()
    assert bytes(raw.data) == b"".join(want["a", i] for i in range(len(sizes)))


def test_tables_before_sequence_parameter_sets(spark):
    rows = spark.createDataFrame([("a", 0, bytearray(b"\0\0\0\x01\x67abc")), ("a", 1, bytearray(b"\0\0\0\x01\x41x")), ("a", 2, bytearray(b"\0\0\0\x01\x09\xf0\0\0\0\x01\x67y"))], "s string, i int, d binary")
    out = transport.encoded(rows, "s", "i", "d", tables="sps")
    assert sorted((r.i, r.pid) for r in out.where("pid <> 256").collect()) == [(0, 0), (0, 4096), (2, 0), (2, 4096)]


def test_options_that_are_wrong(spark):
    for how in ({"rate": 0}, {"rate": 61}, {"media": "vp8"}, {"tables": "never"}, {"every": 0}):
        with pytest.raises(ValueError):
            transport.encoded(frames(spark, [3]), "stream", "at", "data", **how)


def test_broken_streams(spark):
    def packet(start, data, n=0):
        return pk.ts_packet(256, F.lit(start), F.lit(n), F.lit(None).cast("long"), F.lit(data))

    rows = [packet(False, b"lost"), packet(True, b"no header"), packet(False, b" more"), F.lit(b"short")]
    df = spark.range(1).select(F.posexplode(F.array(*rows)).alias("i", "packet")).withColumn("s", F.lit(1))
    got = transport.demuxed(df, "s", "i").orderBy("n").collect()
    assert [(r.n, r.err, r.data) for r in got] == [(0, "no PES start code", None), (1, "packet is not 188 bytes long", None)]


def test_intervals_and_their_errors(spark):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate((10, 20, 30, 40))], "s int, i int, pts long")
    cut = lambda a, b: tuple(transport.trimmed(rows, a, b, "s", "i").first())[1:]
    assert cut(20, 30) == (1, 1, None) and cut(15, 35) == (0, 2, None) and cut(5, 15) == (0, 0, None) and cut(10, 40) == (0, 2, None)
    assert cut(30, 30)[2] == cut(31, 30)[2] == "PTS interval invalid"
    assert cut(40, 50)[2] == "PTS 'from' cannot be found" and cut(20, 41)[2] == "PTS 'to' cannot be found"


def test_packet_edits(spark):
    packet = bytes([0x47, 0x41, 0x00, 0x15]) + bytes(range(184))
    row = spark.range(1).select(F.lit(packet).alias("p")).select("p", transport.with_adaptation(F.col("p")).alias("a")).select("p", "a", transport.with_adaptation(F.col("a")).alias("again"), transport.with_discontinuity(F.col("a"), F.lit(True)).alias("d"), transport.with_discontinuity(F.col("p"), F.lit(True)).alias("none"), transport.without_flags(F.col("p")).alias("none2"))
    row = row.withColumn("back", transport.without_flags(F.col("d"))).first()
    assert bytes(row.a) == packet[:3] + b"\x35\x01\x00" + packet[4:186] and row.again is row.none is row.none2 is None
    assert bytes(row.d) == packet[:3] + b"\x35\x01\x80" + packet[4:186] and bytes(row.back) == bytes(row.a)


def test_messages_with_long_times(spark):
    body = bytes(range(200))
    out = lambda kind, ms: bytes(spark.range(1).select(transport.rtmp_chunks(F.lit(kind), F.lit(1), 4, F.lit(ms), F.lit(ms), F.lit(200), F.lit(8), F.lit(body)).alias("x")).first().x)
    tail = body[:128] + b"\xc4" + body[128:]
    assert out(12, 0x1000000) == bytes.fromhex("04FFFFFF0000C80801000000") + bytes.fromhex("01000000") + tail
    assert out(4, 40) == bytes.fromhex("84000028") + tail and out(1, 40) == b"\xc4" + tail
    with pytest.raises(ValueError):
        transport.rtmp_chunks(F.lit(12), F.lit(1), 65_600, F.lit(0), F.lit(0), F.lit(0), F.lit(8), F.lit(b""))
    wide = lambda channel: bytes(spark.range(1).select(transport.rtmp_chunks(F.lit(1), F.lit(1), channel, F.lit(0), F.lit(0), F.lit(200), F.lit(8), F.lit(body)).alias("x")).first().x)
    for channel, head in ((64, "C000"), (319, "C0FF"), (320, "C10001"), (65_599, "C1FFFF")):
        head = bytes.fromhex(head)
        assert wide(channel) == head + body[:128] + head + body[128:]


def test_images_with_tables_of_their_own(spark):
    table, scan = bytes(range(1, 129)), b"scan data"
    own = lambda q, t: bytes([0, 0, 0, 0, 1, q, 2, 3]) + (bytes([0, 0]) + len(t).to_bytes(2, "big") + t)
    packets = [own(200, table) + scan, own(200, b"") + scan, own(201, b"") + scan, own(255, b"") + scan, bytes([0, 0, 0, 0, 1, 0, 2, 3]) + scan, bytes([0, 0, 0, 0, 2, 50, 2, 3]) + scan, bytes([0, 0, 0, 0, 0x41, 50, 2, 3, 0, 7, 0, 0]) + scan]
    rows = spark.createDataFrame([(1, i, bytearray(p), True) for i, p in enumerate(packets)], "s int, seq int, payload binary, marker boolean")
    got = [bytes(r.unit) for r in reassembly.units(rows, "jfif", "s", "seq").orderBy("n").collect()]
    whole = jpeg.jfif_header(1, 16, 24, 0, table) + scan + b"\xff\xd9"
    assert got == [whole, whole, jpeg.jfif_header(1, 16, 24, 7, jpeg.quant_tables(50)) + scan + b"\xff\xd9"]
    assert b"\xff\xdd\x00\x04\x00\x07" in got[2] and whole[:4] == b"\xff\xd8\xff\xe0"
