"""Whole transport streams: frames into packets with their tables, packets back into frames with their metadata, and trimming.

A stream is any column and frames follow an order column, so many streams are packed at once. Every function is windows,
projections and one explode; what one frame or packet needs from those before it is a running sum.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle.functions import meta as m
from riffle.functions import packing as pk
from riffle.functions import parsing as ps
from riffle.functions import splitting
from riffle.functions.bytesx import chunks, crc32_mpeg2, let, padded, put_be, u8
from riffle.operators.ordered import window

PAT_PID, PMT_PID, META_TAG, TIME_KEY = 0, 4096, 0x26, "ts"
#: Ticks by which frames are shown after the clock: 0.7 seconds.
PTS_LEAD = 63_000
MEDIA = {name: (pid, stream) for name, _, pid, stream in m.CODECS}


@F.pandas_udf(T.BinaryType())
def one_after_another(parts: pd.Series) -> pd.Series:
    """An array of bytes as one value."""
    return parts.map(lambda p: b"".join(p))


def table_packet(pid: int, cc: Column, section: Column) -> Column:
    """A packet that holds one section behind a pointer of 0, filled up with FF."""
    return F.concat(F.unhex(F.concat(F.lit("47"), put_be(F.lit(0x4000 + pid), 2), put_be(cc % 16 + 0x10, 1))), padded(F.concat(F.unhex(F.lit("00")), section), 184))


def with_time(entries: Column, seconds: Column) -> Column:
    """Metadata with the time in it: the entry keeps its place, or goes to the end."""
    return m.upserted(entries, F.lit(TIME_KEY), seconds.cast("long").cast("string"))


def _by_packets(every: int):
    """Which frames come behind new tables: the first, and each one before which ``every`` packets or more were written since the last tables."""

    def mark(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        flags, written = [], every
        for n in rows.column("n").to_pylist():
            flags.append(written >= every)
            written = (2 if flags[-1] else written) + n
        return pa.table({"stream": rows.column("stream"), "at": rows.column("at"), "tables": pa.array(flags)})

    return mark


def encoded(frames: DataFrame, stream: str, order: str, data: str, media: str = "h264", rate: float = 25.0, tables: str = "packets", every: float = 40, meta: Column | None = None) -> DataFrame:
    """Frames as packets: ``stream, order, sub, pid, packet``, to be read in the order of ``order`` and ``sub``.

    ``tables`` says when PAT and PMT are written again: "packets" (before the first frame and whenever ``every`` packets were
    written since), "seconds" (each ``every`` seconds of the stream's clock), or "sps" (before frames that begin with a sequence
    parameter set). ``meta`` is ordered metadata (array of k, v) for the PMT of each frame.
    """
    if not 1 <= rate <= 60:
        raise ValueError("rate must be from 1 to 60")
    if media not in MEDIA:
        raise ValueError(f"no media type {media}")
    if tables not in ("packets", "seconds", "sps") or every <= 0:
        raise ValueError("tables come by packets, seconds or sps")
    pid, stream_id = MEDIA[media]
    rows = frames.select(F.col(stream).alias("stream"), F.col(order).alias("at"), F.col(data).alias("data"), (F.array().cast("array<struct<k:string,v:string>>") if meta is None else meta).alias("meta"))
    rows = rows.withColumn("i", (F.row_number().over(window("stream", "at")) - 1).cast("long"))
    rows = rows.withColumn("n", F.greatest(F.lit(0), F.ceil((F.octet_length("data") + 14 - pk.TS_ROOM_PCR) / pk.TS_ROOM)) + 1)
    if tables == "packets":
        kind = ", ".join(f"{c} {t}" for c, t in rows.select("stream", "at").dtypes)
        marks = rows.select("stream", "at", "n").groupBy("stream").applyInArrow(_by_packets(int(every)), f"{kind}, tables boolean")
        rows = rows.join(marks, ["stream", "at"])
    elif tables == "seconds":
        turn = lambda i: F.floor(i / F.lit(rate * every))
        rows = rows.withColumn("tables", (F.col("i") == 0) | (turn(F.col("i")) != turn(F.col("i") - 1)))
    else:
        rows = rows.withColumn("tables", F.coalesce(splitting.nal_type(splitting.nal_units(F.col("data"))) == 7, F.lit(False)))
    w = window("stream", "at")
    rows = rows.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("psi", F.sum(F.col("tables").cast("long")).over(w) - 1)
    clock = F.floor(F.col("i") * 90_000 / F.lit(rate)).cast("long")
    rows = rows.withColumn("pcr", clock % (1 << 33)).withColumn("pieces", pk.ts_pieces(pk.pes(stream_id, (clock + PTS_LEAD) % (1 << 33), F.col("data"))))
    descriptor = F.when(F.size("meta") > 0, pk.descriptor(META_TAG, m.encoded(F.col("meta")))).otherwise(F.lit(b""))
    psi = F.array(
        F.struct(F.lit(0).alias("sub"), F.lit(PAT_PID).alias("pid"), table_packet(PAT_PID, F.col("psi"), pk.pat(1, 1, PMT_PID)).alias("packet")),
        F.struct(F.lit(1).alias("sub"), F.lit(PMT_PID).alias("pid"), table_packet(PMT_PID, F.col("psi"), pk.pmt(1, pid, descriptor, stream_id)).alias("packet")),
    )
    tabled = rows.where("tables").select("stream", "at", F.inline(psi))
    pieces = rows.select("stream", "at", "before", "pcr", F.posexplode("pieces").alias("j", "piece"))
    media_rows = pieces.select("stream", "at", (F.col("j") + 2).alias("sub"), F.lit(pid).alias("pid"), pk.ts_packet(pid, F.col("j") == 0, F.col("before") + F.col("j"), F.when(F.col("j") == 0, F.col("pcr")), F.col("piece")).alias("packet"))
    return tabled.unionByName(media_rows).withColumnsRenamed({"stream": stream, "at": order})


def demuxed(packets: DataFrame, stream: str, *order: str, packet: str = "packet", pmt_pid: int = PMT_PID) -> DataFrame:
    """Frames of packets: ``stream, n, pts, stream_id, meta, idx, data, err``.

    A frame begins with a unit start; packets before the first one are left out. meta is the text of the latest PMT's metadata before the
    frame, and idx is where the frame begins in the media of its stream. err names packets that are none and frames without a
    PES header or a time.
    """
    f = ps.ts_fields(F.col(packet))
    rows = packets.select(F.col(stream).alias("stream"), F.struct(*order).alias("at"), f["pid"].alias("pid"), f["pusi"].alias("pusi"), f["payload"].alias("payload"), f["err"].alias("err"))
    rows = rows.where(F.col("err").isNotNull() | (F.col("pid") != PAT_PID))

    def text_of(descriptor: Column) -> Column:
        held, problem = m.decoded(descriptor)
        return F.coalesce(F.when(problem.isNull(), m.encoded_text(held)), F.lit(""))

    # each step is computed once, and only for tables
    section = lambda p: F.substring(p, (u8(p, 0) + 2).cast("int"), F.lit(184))
    text = F.when(F.col("pid") == pmt_pid, let(F.col("payload"), lambda p: let(section(p), lambda t: let(ps.has_descriptor(t, META_TAG), text_of))))
    w = window("stream", "at")
    media = F.coalesce(F.col("pid") != pmt_pid, F.lit(True))
    rows = rows.withColumn("meta", F.last(text, ignorenulls=True).over(w)).where(media)
    rows = rows.withColumn("n", F.sum(F.coalesce(F.col("pusi"), F.lit(False)).cast("int")).over(w) - 1).where("n >= 0")
    whole = rows.groupBy("stream", "n").agg(F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("parts"), F.min_by("meta", "at").alias("meta"), F.min_by("err", "at").alias("bad"))
    whole = whole.withColumn("pes", one_after_another(F.transform("parts", lambda p: F.coalesce(p["payload"], F.lit(b"")))))
    g = ps.pes_fields(F.col("pes"))
    whole = whole.select("stream", "n", g["pts"].alias("pts"), g["stream_id"].alias("stream_id"), "meta", g["data"].alias("data"), F.coalesce("bad", g["err"]).alias("err"))
    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("long")
    whole = whole.withColumn("idx", F.sum(size).over(window("stream", "n")) - size)
    return whole.withColumnRenamed("stream", stream)


def raw_media(packets: DataFrame, pid: int, stream: str, *order: str, packet: str = "packet") -> DataFrame:
    """``stream, data``: the media of one PID of each stream, without any headers, as one value (2 GB at most; ``demuxed`` has no such limit)."""
    rows = demuxed(packets.where(ps.ts_fields(F.col(packet))["pid"] == pid), stream, *order, packet=packet)
    whole = rows.where("err IS NULL").groupBy(stream).agg(F.array_sort(F.collect_list(F.struct("n", "data"))).alias("parts"))
    return whole.select(stream, one_after_another(F.transform("parts", lambda p: p["data"])).alias("data"))


def trimmed(frames: DataFrame, low: int, high: int, stream: str, order: str, pts: str = "pts") -> DataFrame:
    """Per stream the frames of an interval as ``stream, first, last, err``: from the frame that contains ``low`` to the one before the
    first at or after ``high``. err: the interval is none, its beginning is behind the last frame but one, or its end is behind the last frame."""
    if low >= high:
        return frames.select(stream).distinct().select(stream, F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.lit("PTS interval invalid").alias("err"))
    after = F.lead(pts).over(window(stream, order))
    rows = frames.select(stream, order, pts, after.alias("after"))
    key = F.col(order).cast("long")
    first = F.min(F.when(F.col("after") > low, key))
    found = rows.groupBy(stream).agg(first.alias("first"))
    rows = rows.join(found, stream)
    # the last frame before the first one behind ``first`` that is at or after ``high``
    last = F.min(F.when((key >= F.col("first")) & (F.col("after") >= high), key))
    out = rows.groupBy(stream, "first").agg(last.alias("last"))
    err = F.when(F.col("first").isNull(), "PTS 'from' cannot be found").when(F.col("last").isNull(), "PTS 'to' cannot be found")
    good = lambda c: F.when(err.isNull(), F.col(c)).alias(c)
    return out.select(stream, good("first"), good("last"), err.alias("err"))


def with_adaptation(packet: Column) -> Column:
    """A packet with an empty adaptation field of two bytes behind its header; the last two bytes of the payload go. Null where there is a field already."""
    control = u8(packet, 3)
    return F.when(control.bitwiseAND(0x20) == 0, F.concat(F.substring(packet, 1, 3), F.unhex(put_be(control.bitwiseOR(F.lit(0x30)), 1)), F.unhex(F.lit("0100")), F.substring(packet, 5, 182)))


def without_flags(packet: Column) -> Column:
    """The adaptation field set back to one byte of no flags. Null where there is none."""
    return F.when(u8(packet, 3).bitwiseAND(0x20) != 0, F.overlay(packet, F.unhex(F.lit("0100")), F.lit(5), F.lit(2)))


def with_counter(packet: Column, cc: Column) -> Column:
    return F.overlay(packet, F.unhex(put_be(u8(packet, 3).bitwiseAND(0xF0).bitwiseOR((cc % 16).cast("long")), 1)), F.lit(4), F.lit(1))


def with_discontinuity(packet: Column, flag: Column) -> Column:
    """The discontinuity bit set or cleared. Null where there is no adaptation field."""
    flags = u8(packet, 5).bitwiseAND(0x7F).bitwiseOR(F.when(flag, 0x80).otherwise(0))
    return F.when((u8(packet, 3).bitwiseAND(0x20) != 0) & (u8(packet, 4) > 0), F.overlay(packet, F.unhex(put_be(flags, 1)), F.lit(6), F.lit(1)))


# Tags, places and sizes of the time and location that older tables hold right behind a pointer field.
TIME_TAG, TIME_AT, PLACE_TAG, PLACE_AT, PLACE_SIZE = 234, 13, 235, 23, 32


def has_time(table: Column) -> Column:
    return F.coalesce(u8(table, TIME_AT) == TIME_TAG, F.lit(False))


def has_place(table: Column) -> Column:
    return F.coalesce(u8(table, PLACE_AT) == PLACE_TAG, F.lit(False))


def place_of(table: Column) -> Column:
    """The location without the zeros around it; null where the table has none."""
    return F.when(has_place(table), F.regexp_replace(F.decode(F.substring(table, PLACE_AT + 3, PLACE_SIZE), "ISO-8859-1"), "^\x00+|\x00+$", ""))


def section_length(table: Column) -> Column:
    return F.shiftleft(u8(table, 2).bitwiseAND(3), 8).bitwiseOR(u8(table, 3))


def _checked(table: Column) -> Column:
    """A table behind a pointer field with its CRC made anew."""
    return let(F.substring(table, F.lit(1), F.octet_length(table) - 4), lambda t: F.concat(t, F.unhex(put_be(crc32_mpeg2(F.substring(t, F.lit(2), F.lit(1 << 20))), 4))))


def with_new_time(table: Column, seconds: Column) -> Column:
    """The time replaced; null where the table has none."""
    return F.when(has_time(table), _checked(F.overlay(table, F.unhex(put_be(seconds, 8)), F.lit(TIME_AT + 3), F.lit(8))))


def with_new_place(table: Column, place: Column) -> Column:
    """The location replaced, cut or filled up with zeros to its size; null where the table has none."""
    data = padded(F.substring(F.encode(place, "UTF-8"), F.lit(1), F.lit(PLACE_SIZE)), PLACE_SIZE, 0)
    return F.when(has_place(table), _checked(F.overlay(table, data, F.lit(PLACE_AT + 3), F.lit(PLACE_SIZE))))


def flv_header(video: bool = True, audio: bool = True) -> Column:
    """The nine bytes that begin an FLV file, and the size 0 of no tag before the first."""
    return F.unhex(F.lit(f"464C5601{4 * audio + video:02X}0000000900000000"))


def rtmp_channel(kind: Column, channel: Column) -> Column:
    """The first one to three bytes of a header in hex: header kind and channel, which takes one more byte from 64 and two from 320 on."""
    top = F.when(kind == 12, 0).when(kind == 8, 0x40).when(kind == 4, 0x80).otherwise(0xC0)
    far = channel - 64
    wide = F.concat(put_be(top + 1, 1), put_be(far % 256, 1), put_be(F.floor(far / 256), 1))
    return F.when(channel > 319, wide).when(channel > 63, F.concat(put_be(top, 1), put_be(far, 1))).otherwise(put_be(top + channel, 1))


def rtmp_chunks(kind: Column, stream_id: Column, channel: int | Column, timestamp: Column, delta: Column, size: Column, packet_type: Column, body: Column, chunk: int = 128) -> Column:
    """The bytes of a message: a header of 12, 8, 4 or 1 bytes (``kind``), and the body in chunks with the channel between them.

    ``timestamp`` is written in full headers and ``delta`` in the others; 24 bits are all ones where four more bytes follow. Channels go from 2 to 65,599.
    """
    if isinstance(channel, int) and not 2 <= channel <= 65_599:
        raise ValueError("channel must be from 2 to 65599")
    channel = F.lit(channel) if isinstance(channel, int) else channel
    number = F.when(kind == 12, timestamp).otherwise(delta)
    head = F.concat(
        rtmp_channel(kind, channel), F.when(kind > 1, put_be(F.least(number, F.lit(0xFFFFFF)), 3)).otherwise(""), F.when(kind > 4, F.concat(put_be(size, 3), put_be(packet_type, 1))).otherwise(""),
        F.when(kind > 8, F.concat(*[F.substring(put_be(stream_id, 4), 7 - 2 * i, 2) for i in range(4)])).otherwise(""), F.when((kind > 1) & (number >= 0xFFFFFF), put_be(number, 4)).otherwise(""),
    )
    between = F.unhex(rtmp_channel(F.lit(1), channel))
    return F.concat(F.unhex(head), one_after_another(F.transform(chunks(body, chunk), lambda c, i: F.when(i == 0, c).otherwise(F.concat(between, c)))))


def rtmp_sends(messages: DataFrame, stream: str, order: str, chunk: int = 128) -> DataFrame:
    """``messages`` (packet_type, size, head: the bytes of its header) with ``deferred``, ``joined`` and ``sends``: how messages go out.

    A small audio message (type 8, less than a chunk) waits for the next one, unless one waits already. The next one takes it along in its first send
    if both fit into a chunk; else it goes alone before. Each chunk is a send. A message that waits has no sends of its own, and at the end of a stream it stays.
    """
    w = window(stream, order)
    small = (F.col("packet_type") == 8) & (F.col("size") < chunk)
    rows = messages.withColumn("__small", small)
    # of small ones in a row every second waits
    start = F.when(~F.coalesce(F.col("__small"), F.lit(False)) | ~F.coalesce(F.lag("__small").over(w), F.lit(False)), F.row_number().over(w))
    rows = rows.withColumn("__at", F.row_number().over(w)).withColumn("__from", start)
    rows = rows.withColumn("__from", F.last("__from", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("deferred", F.col("__small") & ((F.col("__at") - F.col("__from")) % 2 == 0))
    waits = F.coalesce(F.lag("deferred").over(w), F.lit(False))
    held = F.lag(F.col("size") + F.col("head")).over(w)
    rows = rows.withColumn("__waits", waits).withColumn("joined", waits & (held + F.col("size") + F.col("head") <= chunk))
    own = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1))
    sends = F.when(F.col("deferred"), 0).otherwise(own + (F.col("__waits") & ~F.col("joined")).cast("int"))
    return rows.withColumn("sends", sends.cast("int")).drop("__small", "__at", "__from", "__waits")
