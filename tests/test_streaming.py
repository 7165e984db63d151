"""Streaming operators over files that arrive one by one equal their batch forms."""

import time

import pytest
from pyspark.sql import functions as F

from riffle.operators.ordered import extended_sequence
from riffle.operators.reassembly import H264Units, units
from riffle.plans.reassembly_queries import h264_packets
from riffle.plans.views import packets
from riffle.streaming import stateful

SF = "/root/testdata/sf0.001"


def streamed(spark, df, order, tmp_path, apply, parts=3):
    """Writes ``df`` as a few files in order, reads them as a stream and gives what the operator appended."""
    folder, cut = str(tmp_path / "in"), df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
    edges = [-1e18, *cut, 1e18]
    for a, b in zip(edges, edges[1:], strict=False):
        df.where((F.col(order) > a) & (F.col(order) <= b)).coalesce(1).write.mode("append").parquet(folder)
    name = f"out_{tmp_path.name.replace('-', '_')}"
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    q = apply(stateful.packet_source(spark, folder, schema)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_continuity(spark, tmp_path):
    rows = packets(spark, SF).select("pid", "off", F.col("cc").cast("long").alias("cc"), F.lit(False).alias("failed"))
    got = {(r.pid, r.off): r.discontinuous for r in streamed(spark, rows, "off", tmp_path, stateful.continuity).collect()}
    want, last = {}, {}
    for r in rows.orderBy("off").collect():
        want[r.pid, r.off] = r.pid not in last or r.cc != (last[r.pid] + 1) % 16
        last[r.pid] = r.cc
    assert got == want


def test_cycles(spark, tmp_path):
    rows = packets(spark, SF).select("pid", "off", (F.col("off") * 37 % 4096).alias("seq"))
    got = {tuple(r) for r in streamed(spark, rows, "off", tmp_path, stateful.cycles).collect()}
    assert got == {tuple(r) for r in extended_sequence(rows, "seq", "pid", "off").select("pid", "off", "seq", "cycles").collect()}


def test_units(spark, tmp_path):
    rows = h264_packets(spark, SF)
    got = sorted((r.conv_id, bytes(r.unit)) for r in streamed(spark, rows, "seq", tmp_path, lambda s: stateful.units(s, "h264", "conv_id", "seq")).collect())
    assert got == sorted((r.conv_id, bytes(r.unit)) for r in units(rows, "h264", "conv_id", "seq").collect())


def test_batches(spark, tmp_path):
    rows = spark.range(60).selectExpr("id % 3 AS conv_id", "id AS turn", "cast(repeat(cast(id % 10 AS string), cast((id * 131) % 700 AS int)) AS binary) AS payload")
    got = streamed(spark, rows, "turn", tmp_path, stateful.batches).collect()
    want = []
    for c in range(3):
        held = b""
        for i in range(60):
            if i % 3 == c:
                held += str(i % 10).encode() * (i * 131 % 700)
                if len(held) >= 1316:
                    want.append((c, held))
                    held = b""
    assert sorted((r.conv_id, bytes(r.data)) for r in got) == sorted(want)


def jpeg_packets(spark):
    """Images of one stream in fragments: the tables come with the first one, later ones name them; a number that never came is lost."""
    rows, seq = [], 0
    for image, (number, own) in enumerate([(200, bytes(range(128))), (200, b""), (60, b""), (201, b""), (200, b"")]):
        for part in range(4):
            head = bytes([0, *(100 * part).to_bytes(3, "big"), 1, number, 4, 3])
            tables = b"\0\0" + len(own).to_bytes(2, "big") + own if number > 127 and part == 0 else b""
            rows.append((7, seq, head + tables + bytes([image, part]) * 50, part == 3))
            seq += 1
    return spark.createDataFrame(rows, "stream long, seq long, payload binary, marker boolean")


def test_images_over_many_batches(spark, tmp_path):
    rows = jpeg_packets(spark)
    want = [bytes(r.unit) for r in units(rows, "jfif", "stream", "seq").orderBy("n").collect()]
    got = [bytes(r.unit) for r in streamed(spark, rows, "seq", tmp_path, lambda s: stateful.units(s, "jfif", "stream", "seq"), parts=9).collect()]
    assert len(want) == 4 and sorted(got) == sorted(want)


def test_images_survive_a_restart(spark, tmp_path):
    """Two runs with one checkpoint: what the first has read of an image and its tables is there in the second."""
    rows, folder = jpeg_packets(spark), str(tmp_path / "in")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        found = stateful.units(stateful.packet_source(spark, folder, "stream long, seq long, payload binary, marker boolean"), "jfif", "stream", "seq")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for low, high in ((0, 6), (6, 20)):
        rows.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(folder)
        run()
    want = sorted(bytes(r.unit) for r in units(rows, "jfif", "stream", "seq").collect())
    assert sorted(bytes(r.unit) for r in spark.read.parquet(out).collect()) == want


def test_initial_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 9)], "pid long, off long, cc long")
    before = spark.createDataFrame([(1, 5), (3, 0)], "pid long, expected long")
    got = streamed(spark, rows, "off", tmp_path, lambda s: stateful.continuity(s, initial=before), parts=2)
    assert {(r.pid, r.off): r.discontinuous for r in got.collect()} == {(1, 0): False, (1, 1): False, (2, 0): True}


def test_idle_streams_are_closed(spark, tmp_path):
    """Stream 1 sends once; when nothing more has come, what it held is given out and its state is forgotten."""
    rows = spark.createDataFrame([(1, 0, b"\x67one", False), (1, 1, b"\x67new", False)], "stream long, seq long, payload binary, marker boolean")
    folder = str(tmp_path / "in")
    rows.where("seq = 0").coalesce(1).write.parquet(folder)
    found = stateful.units(stateful.packet_source(spark, folder, "stream long, seq long, payload binary, marker boolean"), "h264", "stream", "seq", idle=0.5)
    query = found.writeStream.queryName("idle_streams").format("memory").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(processingTime="100 milliseconds").start()
    try:
        for n in (1, 2):
            for _ in range(300):
                if spark.table("idle_streams").count() == 2 * n:  # a parameter set ends the empty unit before it
                    break
                time.sleep(0.2)
            if n == 1:
                rows.where("seq = 1").coalesce(1).write.mode("append").parquet(folder)
    finally:
        query.stop()
    empty = b"\0\0\0\1\x09\xf0"
    assert [bytes(r.unit) for r in spark.table("idle_streams").collect()] == [empty, empty + b"\0\0\0\1\x67one", empty, empty + b"\0\0\0\1\x67new"]


@pytest.mark.parametrize("at", [1, 2])
def test_a_packet_inside_a_fragment_loses_the_unit(at):
    machine = H264Units()
    parts = [b"\x7c\x85abc", b"\x7c\x05def", b"\x7c\x45ghi"]
    out = []
    for p in [b"\x67\x42", *parts[:at], b"\x41lost", b"\x65next", b"\x67\x42"]:
        out += machine.take(p)
    assert out[-1] == b"\0\0\0\1\x65next" and not any(b"lost" in u or b"abc" in u for u in out[2:])
