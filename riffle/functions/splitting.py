"""Splitters of byte streams inside a row: NAL units, ADTS frames and JPEG images, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riffle.functions.bytesx import be, from_latin1, latin1, let, u8


def nal_units(data: Column) -> Column:
    """NAL units of an Annex-B stream as ``array<struct<type,nal>>``, without start codes; bytes before the first one go."""
    parts = F.split(latin1(data), "\x00{2,3}\x01")
    return F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != ""), lambda p: let(from_latin1(p), lambda n: F.struct(u8(n, 0).bitwiseAND(31).cast("int").alias("type"), n.alias("nal"))))


def nal_type(units: Column) -> Column:
    """The type of the first unit that is not an access unit delimiter."""
    return F.get(F.filter(units, lambda u: u["type"] != 9), F.lit(0))["type"]


def is_key_frame(units: Column) -> Column:
    """Whether the first slice is of an IDR picture."""
    return F.coalesce(F.get(F.filter(units, lambda u: u["type"].isin(1, 5)), F.lit(0))["type"] == 5, F.lit(False))


def has_sequence_header(units: Column) -> Column:
    """Whether SEI, SPS or PPS comes before the first slice."""
    return F.coalesce(F.get(F.filter(units, lambda u: u["type"].isin(1, 5, 6, 7, 8)), F.lit(0))["type"] >= 6, F.lit(False))


def from_sps(data: Column) -> Column:
    """What begins with the start code of the first SPS; null without one."""
    text = F.regexp_extract(latin1(data), "(?s)(\x00{2,3}\x01[\x07\x27\x47\x67\x87\xa7\xc7\xe7].*)$", 1)
    return F.when(text != "", from_latin1(text))


def rbsp(nal: Column) -> Column:
    """The payload of a NAL unit without emulation prevention bytes."""
    return from_latin1(F.regexp_replace(latin1(F.substring(nal, F.lit(2), F.lit(1 << 30))), "\x00\x00\x03", "\x00\x00"))


def adts_frames(data: Column) -> Column:
    """Frames of an AAC stream as ``array<struct<profile,rate,channels,payload>>``, each read at the end of the one before; a broken or short one ends the walk."""
    kind = "struct<at:int,found:array<struct<profile:int,rate:int,channels:int,payload:binary>>>"

    def walk(s: Column, _: Column) -> Column:
        def read(at: Column) -> Column:
            size = F.shiftright(be(data, at + 3, 3), 5).bitwiseAND(0x1FFF)
            head = F.when(u8(data, at + 1).bitwiseAND(1) == 1, 7).otherwise(9)
            ok = (be(data, at, 2).bitwiseAND(0xFFF6) == 0xFFF0) & (size >= head) & (at + size <= F.octet_length(data))
            item = F.struct(F.shiftright(u8(data, at + 2), 6).cast("int").alias("profile"), F.shiftright(u8(data, at + 2), 2).bitwiseAND(15).cast("int").alias("rate"), F.shiftright(be(data, at + 2, 2), 6).bitwiseAND(7).cast("int").alias("channels"), F.substring(data, at + head + 1, (size - head).cast("int")).alias("payload"))
            return F.when(F.coalesce(ok, F.lit(False)), F.struct((at + size).cast("int").alias("at"), F.concat(s["found"], F.array(item)).alias("found")).cast(kind)).otherwise(F.struct(F.lit(-1).alias("at"), s["found"].alias("found")).cast(kind))

        return F.when(s["at"] < 0, s).otherwise(let(s["at"], read))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<profile:int,rate:int,channels:int,payload:binary>>").alias("found")).cast(kind)
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.octet_length(data) / 7).cast("int")), start, walk)["found"]


def jpeg_images(data: Column) -> Column:
    """Images from start to end marker, inner images included; what is not ended goes. Null where the stream begins otherwise."""
    pieces = F.regexp_extract_all(latin1(data), F.lit("(?s).*?\xff[\xd8\xd9]"), F.lit(0))
    kind = "struct<depth:int,held:string,found:array<string>>"

    def take(s: Column, p: Column) -> Column:
        def moved(v: Column) -> Column:
            return F.when((v["depth"] == 0) & ~v["opens"], F.struct(F.lit(0).alias("depth"), F.lit("").alias("held"), F.concat(s["found"], F.array(v["held"])).alias("found")).cast(kind)).otherwise(F.struct(v["depth"].alias("depth"), v["held"].alias("held"), s["found"].alias("found")).cast(kind))

        opens = F.endswith(p, F.lit("\xd8"))
        return let(F.struct((s["depth"] + F.when(opens, 1).otherwise(-1)).alias("depth"), opens.alias("opens"), F.concat(s["held"], p).alias("held")), moved)

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("held"), F.array().cast("array<string>").alias("found")).cast(kind)
    return F.when(be(data, 0, 2) == 0xFFD8, F.transform(F.aggregate(pieces, start, take)["found"], from_latin1))


def without_first_eight(frame: Column) -> Column:
    """What follows the first eight bytes; frames of eight bytes or fewer stay."""
    return F.when(F.octet_length(frame) > 8, F.substring(frame, F.lit(9), F.lit(1 << 30))).otherwise(frame)


# Numbers of the baseline, high and high 10 profiles.
BASELINE, HIGH, HIGH_10 = 66, 100, 110


def is_constrained_baseline(profile: Column, flags: Column) -> Column:
    """flags: one byte for each bit of a sequence parameter set."""
    return F.coalesce((profile == BASELINE) & (u8(flags, 8) == 1), F.lit(False))


def is_constrained_high(profile: Column, flags: Column) -> Column:
    return F.coalesce((profile == HIGH) & (u8(flags, 12) == 1) & (u8(flags, 13) == 1), F.lit(False))


def is_high_10_intra(profile: Column, flags: Column) -> Column:
    return F.coalesce((profile == HIGH_10) & (u8(flags, 11) == 1), F.lit(False))


def ends_with_start_code(data: Column) -> Column:
    """Whether the last four bytes are a start code."""
    return F.coalesce(F.endswith(F.hex(data), F.lit("00000001")) & (F.octet_length(data) >= 4), F.lit(False))


def ends_with_three_zeros(data: Column) -> Column:
    return F.coalesce(F.endswith(F.hex(data), F.lit("000000")) & (F.octet_length(data) >= 3), F.lit(False))


def more_data(bits_of: Column, at: Column) -> Column:
    """Whether data is left in the bits of a payload, read up to ``at``: anything before its last 1, the stop bit."""
    return F.coalesce(F.length(F.regexp_replace(bits_of, "0*$", "")) - 1 > at, F.lit(False))
