"""Field readers of transport, PES, PSI, RTP and RTCP bytes. A field that is not there is null; ``err`` columns say why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riffle.functions.bytesx import be, crc32_mpeg2, let, put_be, u8


def ts_fields(p: Column) -> dict[str, Column]:
    """Header fields of a 188-byte packet; the payload starts behind the adaptation field."""
    field = F.when(u8(p, 3).bitwiseAND(0x20) != 0, u8(p, 4) + 1).otherwise(F.lit(0))
    has_pcr = (u8(p, 3).bitwiseAND(0x20) != 0) & (u8(p, 4) > 0) & (u8(p, 5).bitwiseAND(0x10) != 0)
    return {
        "pid": be(p, 1, 2).bitwiseAND(0x1FFF), "pusi": be(p, 1, 2).bitwiseAND(0x4000) != 0, "cc": u8(p, 3).bitwiseAND(15), "afc": F.shiftright(u8(p, 3), 4).bitwiseAND(3),
        "discontinuity": (u8(p, 3).bitwiseAND(0x20) != 0) & (u8(p, 5).bitwiseAND(0x80) != 0), "pcr": F.when(has_pcr, F.shiftright(be(p, 6, 6), 15)),
        "payload": F.when(u8(p, 3).bitwiseAND(0x10) != 0, F.substring(p, (field + 5).cast("int"), F.lit(188))),
        "err": F.when(F.octet_length(p) != 188, "packet is not 188 bytes long").when(u8(p, 0) != 0x47, "no sync byte"),
    }


def clock33(p: Column, at: Column | int) -> Column:
    v = be(p, at, 5)
    return F.shiftleft(F.shiftright(v, 33).bitwiseAND(7), 30).bitwiseOR(F.shiftleft(F.shiftright(v, 17).bitwiseAND(32767), 15)).bitwiseOR(F.shiftright(v, 1).bitwiseAND(32767))


def pes_fields(p: Column) -> dict[str, Column]:
    ok = be(p, 0, 3) == 1
    has = ok & (u8(p, 7).bitwiseAND(0x80) != 0)
    return {"stream_id": F.when(ok, u8(p, 3)), "pts": F.when(has, clock33(p, 9)), "data": F.when(ok, F.substring(p, (u8(p, 8) + 10).cast("int"), F.lit(2_147_483_647))), "err": F.when(~F.coalesce(ok, F.lit(False)), "no PES start code").when(~has, "no PTS")}


def descriptors(section: Column) -> Column:
    """The program descriptors of a PMT section as ``array<struct<tag,data>>``: a walk from length to length."""
    total = be(section, 10, 2).bitwiseAND(0x3FF)
    kind = "struct<next:int,found:array<struct<tag:int,data:binary>>>"

    def walk(state: Column, _: Column) -> Column:
        at = state["next"]
        n = u8(section, at + 1)
        item = F.struct(u8(section, at).cast("int").alias("tag"), F.substring(section, at + 3, n.cast("int")).alias("data"))
        step = F.struct((at + 2 + n).cast("int").alias("next"), F.concat(state["found"], F.array(item)).alias("found")).cast(kind)
        return F.when((at < total + 12) & n.isNotNull(), step).otherwise(state)

    start = F.struct(F.lit(12).alias("next"), F.array().cast("array<struct<tag:int,data:binary>>").alias("found")).cast(kind)
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(total / 2).cast("int"))), start, walk)["found"]


def has_descriptor(section: Column, tag: int) -> Column:
    return F.get(F.filter(descriptors(section), lambda d: d["tag"] == tag), F.lit(0))["data"]


def programs(section: Column) -> Column:
    """Of a PAT section: ``map<program, PMT PID>``; program 0 names the network and is left out."""
    n = F.floor((F.octet_length(section) - 12) / 4).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    found = F.transform(at, lambda i: F.struct(be(section, i * 4 + 8, 2).cast("int").alias("key"), be(section, i * 4 + 10, 2).bitwiseAND(0x1FFF).cast("int").alias("value")))
    return F.map_from_entries(F.filter(found, lambda e: e["key"] != 0))


def elementary_streams(section: Column) -> Column:
    """Of a PMT section: ``array<struct<type,pid>>``."""
    kind = "struct<at:int,found:array<struct<type:int,pid:int>>>"
    end = F.octet_length(section) - 4

    def walk(s: Column, _: Column) -> Column:
        at = s["at"]
        item = F.struct(u8(section, at).cast("int").alias("type"), be(section, at + 1, 2).bitwiseAND(0x1FFF).cast("int").alias("pid"))
        after = at + 5 + be(section, at + 3, 2).bitwiseAND(0x3FF)
        return F.when(at + 5 <= end, F.struct(after.cast("int").alias("at"), F.concat(s["found"], F.array(item)).alias("found")).cast(kind)).otherwise(s)

    start = F.struct((be(section, 10, 2).bitwiseAND(0x3FF) + 12).cast("int").alias("at"), F.array().cast("array<struct<type:int,pid:int>>").alias("found")).cast(kind)
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.octet_length(section) / 5).cast("int")), start, walk)["found"]


def with_descriptor(section: Column, tag: int, data: Column) -> Column:
    """A PMT section with the descriptor added, or replaced where it is; lengths and CRC follow. Null above 180 bytes of descriptors."""
    from riffle.functions.packing import _b, _n, descriptor

    old = descriptors(section)
    packed = lambda d: F.concat(put_be(d["tag"], 1), put_be(F.octet_length(d["data"]), 1), F.hex(d["data"]))
    new = F.hex(descriptor(tag, data))
    texts = F.when(F.exists(old, lambda d: d["tag"] == tag), F.transform(old, lambda d: F.when(d["tag"] == tag, new).otherwise(packed(d)))).otherwise(F.concat(F.transform(old, packed), F.array(new)))
    total = be(section, 10, 2).bitwiseAND(0x3FF)
    tail = F.substring(section, (total + 13).cast("int"), (F.octet_length(section) - total - 16).cast("int"))

    def build(d: Column) -> Column:
        body = _b(F.substring(section, F.lit(4), F.lit(7)), _n(F.octet_length(d) + 0xF000, 2), d, tail)
        head = let(body, lambda x: _b(F.substring(section, F.lit(1), F.lit(1)), _n(F.octet_length(x) + (0xB000 + 4), 2), x))
        return F.when(F.octet_length(d) <= 180, let(head, lambda h: F.concat(h, _n(crc32_mpeg2(h), 4))))

    return let(F.unhex(F.array_join(texts, "")), build)


def rtp_fields(p: Column) -> dict[str, Column]:
    """Padding stays part of the payload."""
    n = u8(p, 0).bitwiseAND(15)
    at = n * 4 + 12
    at = at + F.when(u8(p, 0).bitwiseAND(0x10) != 0, be(p, at + 2, 2) * 4 + 4).otherwise(0)
    err = F.when(F.octet_length(p) < 12, "packet is too short").when(F.shiftright(u8(p, 0), 6) != 2, "version is not 2")
    fine = err.isNull()
    return {"marker": F.when(fine, u8(p, 1) >= 128), "seq": F.when(fine, be(p, 2, 2)), "rtp_ts": F.when(fine, be(p, 4, 4)), "ssrc": F.when(fine, be(p, 8, 4)), "n_csrc": F.when(fine, n), "payload": F.when(fine, F.substring(p, (at + 1).cast("int"), F.lit(65_536))), "err": err}


def sender_report_time(p: Column) -> Column:
    """NTP seconds and fraction of a sender report; null for other packets."""
    return F.when((F.shiftright(u8(p, 0), 6) == 2) & (u8(p, 1) == 200), F.struct(be(p, 8, 4).alias("seconds"), be(p, 12, 4).alias("fraction")))


def ntp_micros(seconds: Column, fraction: Column) -> Column:
    """Microseconds of Unix time, to the nearest."""
    return (seconds - 2_208_988_800) * 1_000_000 + F.round(fraction * 1_000_000 / 4_294_967_296).cast("long")
