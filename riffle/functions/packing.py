"""Packers: rows to the bytes of transport packets, PES, PSI, FLV, RTP, RTCP and RTMP headers. All Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riffle.functions.bytesx import crc32_mpeg2, let, put_be

TS_SIZE, TS_ROOM, TS_ROOM_PCR = 188, 182, 176


def _b(*parts: Column | str) -> Column:
    """Hex texts and binaries, one after another, as binary."""
    return F.concat(*[F.unhex(F.lit(p)) if isinstance(p, str) else p for p in parts])


def _n(v: Column | int, n: int) -> Column:
    return F.unhex(put_be(v if isinstance(v, Column) else F.lit(v), n))


def clock33(prefix: int, v: Column) -> Column:
    """A 33-bit clock in five bytes with marker bits, as PES headers hold it."""
    v = v.cast("long")
    return _n(F.lit(prefix << 36).bitwiseOR(F.shiftleft(F.shiftright(v, 30).bitwiseAND(7), 33)).bitwiseOR(F.shiftleft(F.shiftright(v, 15).bitwiseAND(32767), 17)).bitwiseOR(F.shiftleft(v.bitwiseAND(32767), 1)).bitwiseOR(F.lit(0x100010001)), 5)


def pes(stream_id: Column | int, pts: Column, data: Column) -> Column:
    """A PES packet of unbounded length with a presentation time."""
    return _b("000001", _n(stream_id, 1), "0000", "80", "80", "05", clock33(2, pts), data)


def ts_packet(pid: Column | int, start: Column, cc: Column, pcr: Column, data: Column) -> Column:
    """188 bytes: header, adaptation field (always there, with the clock where ``pcr`` is not null, filled up with FF) and data."""
    pid = pid if isinstance(pid, Column) else F.lit(pid)
    clock = F.when(pcr.isNotNull(), _b(_n(F.shiftleft(pcr.cast("long"), 15).bitwiseOR(F.lit(0x7E00)), 6))).otherwise(_b(F.lit(b"")))
    fill = F.lit(TS_ROOM) - F.octet_length(clock) - F.octet_length(data)
    return _b("47", _n(F.when(start, 0x4000).otherwise(0) + pid, 2), _n(cc % 16 + 0x30, 1), _n(F.lit(183) - F.octet_length(data), 1), _n(F.when(pcr.isNotNull(), 0x10).otherwise(0), 1), clock, F.unhex(F.repeat(F.lit("FF"), fill)), data)


def ts_pieces(data: Column) -> Column:
    """The pieces of a PES packet that go into packets: the first leaves room for the clock."""
    rest = F.greatest(F.lit(0), F.octet_length(data) - TS_ROOM_PCR)
    n = F.ceil(rest / TS_ROOM).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(data, F.when(i == 0, 1).otherwise(TS_ROOM_PCR + 1 + (i - 1) * TS_ROOM), F.when(i == 0, TS_ROOM_PCR).otherwise(TS_ROOM)))


def descriptor(tag: int, data: Column) -> Column:
    return let(data, lambda d: _b(_n(tag, 1), _n(F.octet_length(d), 1), d))


def _section(table_id: int, id_: Column | int, body: Column) -> Column:
    head = let(body, lambda x: _b(_n(table_id, 1), _n(F.octet_length(x) + (0xB000 + 9), 2), _n(id_, 2), "C1", "00", "00", x))
    return let(head, lambda h: F.concat(h, _n(crc32_mpeg2(h), 4)))


def pat(stream: Column | int, program: int, pmt_pid: int) -> Column:
    return _section(0, stream, _b(_n(program, 2), _n(0xE000 + pmt_pid, 2)))


def pmt(program: Column | int, pid: int, descriptors: Column, stream_type: int) -> Column:
    return _section(2, program, let(descriptors, lambda d: _b(_n(0xE000 + pid, 2), _n(F.octet_length(d) + 0xF000, 2), d, _n(stream_type, 1), _n(0xE000 + pid, 2), "F000")))


def flv_video_tag(timestamp: Column, key: Column, codec: int, packet_type: int, data: Column) -> Column:
    """11-byte header, frame and codec, packet type, composition time 0, data, and the size of it all."""
    body = _b(_n(F.when(key, 0x10).otherwise(0x20) + codec, 1), _n(packet_type, 1), "000000", data)
    return _b("09", _n(F.octet_length(body), 3), _n(timestamp, 3), "00", "000000", body, _n(F.octet_length(body) + 11, 4))


def flv_audio_tag(timestamp: Column, head: int, data: Column) -> Column:
    body = _b(_n(head, 1), data)
    return _b("08", _n(F.octet_length(body), 3), _n(timestamp, 3), "00", "000000", body, _n(F.octet_length(body) + 11, 4))


def rtp_packet(marker: Column, kind: int, seq: Column, timestamp: Column, ssrc: Column, data: Column, csrc: Column | None = None, extension: Column | None = None) -> Column:
    """Version 2, without padding. csrc: an array of numbers; extension: bytes in whole words, under profile BEDE."""
    n = F.size(csrc) if csrc is not None else F.lit(0)
    more = F.unhex(F.array_join(F.transform(csrc, lambda c: put_be(c, 4)), "")) if csrc is not None else F.lit(b"")
    ext = _b("BEDE", _n(F.octet_length(extension) / 4, 2), extension) if extension is not None else F.lit(b"")
    return _b(_n(F.lit(0x80 + (0x10 if extension is not None else 0)) + n, 1), _n(F.when(marker, 0x80).otherwise(0) + kind, 1), _n(seq % 65_536, 2), _n(timestamp, 4), _n(ssrc, 4), more, ext, data)


def rtcp_receiver_report(ssrc: Column, source: Column, highest: Column, last_sr: Column, delay: Column) -> Column:
    """One report block; packets lost are not measured."""
    return _b("81", "C9", "0007", _n(ssrc, 4), _n(source, 4), "FFFFFFFF", _n(highest, 4), "00000000", _n(last_sr, 4), _n(delay, 4))


def rtcp_sender_report(ssrc: Column, seconds: Column, fraction: Column, timestamp: Column, packets: Column, octets: Column) -> Column:
    return _b("80", "C8", "0006", _n(ssrc, 4), _n(seconds, 4), _n(fraction, 4), _n(timestamp, 4), _n(packets, 4), _n(octets, 4))


def rtcp_description(ssrc: Column, name: Column) -> Column:
    """One chunk with one CNAME, filled up with zeros to whole words, with one zero at least."""
    item = _b("01", _n(F.octet_length(name), 1), name)
    fill = F.lit(4) - F.octet_length(item) % 4
    return _b("81", "CA", _n((F.octet_length(item) + fill) / 4 + 1, 2), _n(ssrc, 4), item, F.unhex(F.repeat(F.lit("00"), fill)))


def rtmp_header_size(same_stream: Column, same_size_and_type: Column, same_delta: Column) -> Column:
    """Bytes of the basic and message header by what a message shares with the one before on its channel."""
    return F.when(~F.coalesce(same_stream, F.lit(False)), 12).when(~same_size_and_type, 8).when(~same_delta, 4).otherwise(1)


def audio_specific_config(profile: Column, rate_index: Column, channels: Column) -> Column:
    """The two bytes of an AAC configuration: object type, rate index and channels."""
    return _n(F.shiftleft(profile.cast("long") + 1, 11).bitwiseOR(F.shiftleft(rate_index.cast("long"), 7)).bitwiseOR(F.shiftleft(channels.cast("long"), 3)), 2)
