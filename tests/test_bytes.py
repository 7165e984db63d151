"""Known values and round trips of the byte layer."""

import math
import struct
import wave
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from riffle.functions import bytesx as b
from riffle.functions import meta as m
from riffle.functions import packing as pk
from riffle.functions import parsing as ps
from riffle.functions import splitting as sp
from riffle.operators import continuity, dsp, ordered, reassembly, sound, sync
from riffle.plans.signal_queries import wav_file


def one(spark, *columns, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return df.select(*columns).first()


def test_crc_of_known_sections(spark):
    pat = bytes.fromhex("00b00d0001c100000001f000")
    got = one(spark, F.hex(b.crc32_mpeg2(F.col("x"))), F.hex(pk.pat(1, 1, 4096)), x=pat)
    assert got[0] == "2AB104B2" and got[1] == "00B00D0001C100000001F0002AB104B2"
    assert one(spark, b.crc32_mpeg2(F.col("x")), x=b"")[0] == 0xFFFFFFFF and one(spark, b.crc32_mpeg2(F.col("x")), x=b"123456789")[0] == 0x0376E6E7


def test_chunks_and_scan(spark):
    data = bytes.fromhex("1000f345fed2aa4e")
    for n in (1, 2, 3, 4, 15):
        pieces = one(spark, b.chunks(F.col("x"), n), x=data)[0]
        assert b"".join(map(bytes, pieces)) == data and all(len(p) == n for p in pieces[:-1])
    for n in (0, -1):
        with pytest.raises(ValueError):
            b.chunks(F.col("x"), n)
    assert [bytes(p) for p in one(spark, b.split_after(F.col("x"), 0), x=b"one\0two\0\0end")[0]] == [b"one\0", b"two\0", b"\0", b"end"]
    assert one(spark, b.chunks(F.col("x"), 4), x=b"")[0] == [] and one(spark, b.bits(F.col("x")), x=b"\x05\xff")[0] == "0000010111111111"


def test_numbers(spark):
    x = bytes([0x00, 0x80, 0xFF, 0x47])
    got = one(spark, *[b.u8(F.col("x"), i) for i in range(5)], b.be(F.col("x"), 1, 3), b.le(F.col("x"), 0, 4), b.signed(b.le(F.col("x"), 1, 2), 16), x=x)
    assert list(got) == [0, 128, 255, 71, None, 0x80FF47, struct.unpack("<I", x)[0], struct.unpack("<h", x[1:3])[0]]


def test_clock_round_trip(spark):
    for pts in (0, 1, 123_456_789, 2**33 - 1):
        p = one(spark, pk.pes(0xE0, F.col("t"), F.lit(b"media")).alias("p"), t=pts).p
        got = one(spark, *[c.alias(k) for k, c in ps.pes_fields(F.col("p")).items()], p=bytes(p))
        assert (got.stream_id, got.pts, bytes(got.data), got.err) == (0xE0, pts, b"media", None)
    assert one(spark, ps.pes_fields(F.col("p"))["err"], p=b"nothing here.")[0] == "no PES start code"


def test_packets(spark):
    p = one(spark, pk.ts_packet(4096, F.lit(True), F.lit(19), F.lit(12_345).cast("long"), F.col("d")).alias("p"), d=b"x" * 100).p
    got = one(spark, *[c.alias(k) for k, c in ps.ts_fields(F.col("p")).items()], p=bytes(p))
    assert (len(p), got.pid, got.pusi, got.cc, got.pcr, bytes(got.payload), got.err) == (188, 4096, True, 3, 12_345, b"x" * 100, None)
    assert one(spark, ps.ts_fields(F.col("p"))["err"], p=b"short")[0] == "packet is not 188 bytes long"
    r = one(spark, *[c.alias(k) for k, c in ps.rtp_fields(F.col("p")).items()], p=bytes.fromhex("80e0000700000001000000ff") + b"pay")
    assert (r.marker, r.seq, r.rtp_ts, r.ssrc, r.n_csrc, bytes(r.payload)) == (True, 7, 1, 255, 0, b"pay")
    assert one(spark, ps.rtp_fields(F.col("p"))["err"], p=b"\x40" * 12)[0] == "version is not 2"


def test_metadata(spark):
    good = bytes.fromhex("00100012") + b"loc=a,b,c\tts=12345"
    kv, err = m.decoded(F.col("x"))
    assert [tuple(e) for e in one(spark, kv, x=good)[0]] == [("loc", "a,b,c"), ("ts", "12345")] and one(spark, err, x=good)[0] is None
    assert one(spark, err, x=b"\0\x11\0\0")[0] == "not metadata" and one(spark, err, x=b"\0\x10\0\x09a")[0] == "wrong length"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("rtmp://host/app/play", (0, "host", 1935, "app", "play", None)), ("rtmp://host:7777/app/sub/play.mp4", (0, "host:7777", 7777, "app", "mp4:sub/play", None)), ("rtmpt://host/app/mp3:x.mp3?k=v", (1, "host", 80, "app", "mp3:x?k=v", None)),
        ("rtmp://host/app/x.flv", (0, "host", 1935, "app", "x", None)), ("http://host/app/x", (None, None, None, None, None, "unknown scheme")), ("rtmp://host", (None, None, None, None, None, "invalid path")), ("rtmp://host/app", (None, None, None, None, None, "invalid elements")),
    ],
)
def test_urls(spark, url, want):
    assert tuple(one(spark, *m.url_fields(F.col("u")).values(), u=url)) == want


def test_adpcm_round_trip_is_close(spark):
    s = [int(8000 * math.sin(i / 7)) for i in range(400)]
    data = struct.pack("<400h", *s)
    got = struct.unpack("<400h", one(spark, sound.adpcm_decoded(sound.adpcm_encoded(F.col("x"))["data"])["data"], x=data)[0])
    assert len(got) == 400 and got[0] == s[0] and max(abs(a - c) for a, c in zip(got[5:], s[5:], strict=True)) < 1500


def test_filters_pass_and_stop(spark):
    rate, taps = 8000, 100
    tone = lambda f: [math.sin(2 * math.pi * f * i / rate) for i in range(400)]
    power = lambda h, f: sum(v * v for v in one(spark, dsp.convolved(F.col("x"), h), x=tone(f))[0][150:350]) / 200
    low, band = dsp.lowpass(taps, 1500, rate), dsp.bandpass(taps, 1200, 2400, rate)
    assert power(low, 500) > 0.3 > 0.01 > power(low, 3000)
    assert power(band, 1800) > 0.2 > 0.01 > max(power(band, 300), power(band, 3500))
    for bad in (0, 4000, -1):
        with pytest.raises(ValueError):
            dsp.lowpass(taps, bad, rate)


def test_wav_is_readable(spark):
    row = wav_file(spark, "/root/testdata/sf0.001").first()
    with wave.open(BytesIO(bytes.fromhex(row.wav))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (1, 2, 8000, 64)


def test_jpeg_frames(spark):
    images = one(spark, sp.jpeg_images(F.col("x")), x=b"\xff\xd8a\xff\xd8b\xff\xd9c\xff\xd9\xff\xd8d\xff\xd9\xff\xd8e")[0]
    assert [bytes(i) for i in images] == [b"\xff\xd8a\xff\xd8b\xff\xd9c\xff\xd9", b"\xff\xd8d\xff\xd9"]
    assert one(spark, sp.jpeg_images(F.col("x")), x=b"no image")[0] is None


def test_rbsp_and_trim(spark):
    assert bytes(one(spark, sp.rbsp(F.col("x")), x=b"\x67\0\0\3\1\0\0\3\2")[0]) == b"\0\0\1\0\0\2"
    assert bytes(one(spark, sp.from_sps(F.col("x")), x=b"junk\0\0\1\x41a\0\0\0\1\x67b\0\0\1\x68c")[0]) == b"\0\0\0\1\x67b\0\0\1\x68c"


def test_ranges_and_greedy_pairs(spark):
    frames = spark.createDataFrame([(1, i, 4 * i) for i in range(10)], "s int, i int, pts long")
    assert [r.i for r in ordered.pts_range(frames, 6, 15, "s", "i").orderBy("i").collect()] == [1, 2, 3]
    left = spark.createDataFrame([("a", 0.0, 1), ("a", 40.0, 2), ("a", 45.0, 3)], "p string, ms double, frame long")
    right = spark.createDataFrame([("a", 8.0, 7), ("a", 43.0, 8), ("a", 90.0, 9)], "p string, ms double, frame long")
    assert sorted((r.left_frame, r.right_frame) for r in sync.greedy_pairs(left, right, "p").collect()) == [(1, 7), (2, 8)]


def test_h265_and_jpeg_machines():
    h = reassembly.H265Units(donl=True)
    assert h.take(b"\x62\x01\x93\0\0ab") == [] and h.take(b"\x62\x01\x53\0\0cd", True) == [b"\0\0\0\1\x26\x01abcd"]
    j = reassembly.JpegScans()
    assert j.take(b"\0\0\0\x08\1\x32\1\1lost") == [] and j.take(b"\0\0\0\0\1\x32\1\1ab") == [] and j.take(b"\0\0\1\0\1\x32\1\1cd", True) == [b"abcd"]


def test_repaired_counter(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([14, 15, 1, 2])], "pid int, off int, cc int")
    assert [r.c for r in rows.select("off", continuity.repaired_cc().alias("c")).orderBy("off").collect()] == [14, 15, 0, 1]


def test_descriptor_edits_equal_a_fresh_section(spark):
    from riffle.functions.packing import descriptor, pmt

    d = lambda t, x: descriptor(t, F.lit(x))
    cases = [(F.lit(b""), 5, b"abc", d(5, b"abc")), (F.concat(d(5, b"abc"), d(7, b"z")), 5, b"longer than before", F.concat(d(5, b"longer than before"), d(7, b"z"))), (d(5, b"abc"), 9, b"", F.concat(d(5, b"abc"), d(9, b"")))]
    for old, tag, data, new in cases:
        got = one(spark, ps.with_descriptor(pmt(3, 256, old, 27), tag, F.lit(data)), pmt(3, 256, new, 27), ps.elementary_streams(pmt(3, 256, new, 27)))
        assert got[0] == got[1] and [tuple(s) for s in got[2]] == [(27, 256)]
    assert one(spark, ps.with_descriptor(pmt(3, 256, F.lit(b""), 27), 5, F.lit(b"x" * 200)))[0] is None
    assert one(spark, ps.programs(pk.pat(1, 4, 4096)))[0] == {4: 4096}


def test_exp_golomb_tables(spark):
    from riffle.functions import h264 as h

    bits = "1" "010" "011" "00100" "00101" "00110" "00111" "0001000"
    assert one(spark, h.ue_values(F.col("b"), F.lit(20)), b=bits)[0] == list(range(8))
    assert [one(spark, h.signed(F.lit(k)))[0] for k in range(6)] == [0, 1, -1, 2, -2, 3]
    assert one(spark, h.te_value(F.lit("0"), F.lit(1)), h.te_value(F.lit("1"), F.lit(1)), h.te_value(F.lit("00101"), F.lit(5)))[0:] == (1, 0, 4)
    assert all(sorted(t) == list(range(len(t))) for t in h.CBP.values())
    assert [one(spark, h.ueg(F.lit(v), 9, 3, True))[0] for v in (0, -3, 9, 17)] == ["0", "11101", "1" * 9 + "0000" + "0", "1" * 9 + "10" + "0000" + "0"]
