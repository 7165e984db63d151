"""Reassembly of RTP payloads into access units and images.

Each kind has a small machine with a few bytes of state: it takes one payload and gives the units that are complete. The
same machine serves batches, where the packets of a stream are sorted and folded in one group, and streams, where the
state is kept between micro-batches (``riffle.streaming``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from riffle.functions.jpeg import jfif_header, quant_tables

START = b"\0\0\0\1"
DELIMITER = START + b"\x09\xf0"


class H264Units:
    """Single units, STAP-A and FU-A. SPS and slices end the unit before them. A packet that breaks into a fragment is lost with the unit so far."""

    def __init__(self, held: bytes = DELIMITER, fragment: bool = False):
        self.held, self.fragment = held, fragment

    def _begin(self, nal: bytes) -> list[bytes]:
        done = []
        if self.held and nal and nal[0] & 31 in (1, 5, 7):
            done, self.held = [self.held], DELIMITER
        self.held += START + nal
        return done

    def take(self, payload: bytes, marker: bool = False) -> list[bytes]:
        kind = payload[0] & 31 if payload else 0
        if self.fragment and kind != 28:
            self.held, self.fragment = b"", False
            return []
        if 1 <= kind <= 23:
            return self._begin(payload) if len(payload) >= 2 else []
        if kind == 24:
            done, at = [], 1
            while at + 2 <= len(payload):
                size = int.from_bytes(payload[at : at + 2], "big")
                done += self._begin(payload[at + 2 : at + 2 + size])
                at += 2 + size
            return done
        if kind == 28 and len(payload) >= 2:
            if payload[1] & 0x80:
                self.fragment = True
                return self._begin(bytes([payload[0] & 0xE0 | payload[1] & 31]) + payload[2:])
            self.fragment = not payload[1] & 0x40
            self.held += payload[2:]
        return []


class H265Units:
    """Single units, aggregation and fragmentation packets; the marker ends a unit. donl: packets carry decoding order numbers."""

    def __init__(self, held: bytes = b"", fragment: bool = False, donl: bool = False):
        self.held, self.fragment, self.donl = held, fragment, donl

    def take(self, payload: bytes, marker: bool = False) -> list[bytes]:
        kind = payload[0] >> 1 & 63 if payload else 0
        if self.fragment and kind != 49:
            self.held, self.fragment = b"", False
            return []
        if kind == 48:
            at = 2
            while at < len(payload):
                at += (2 if at == 2 else 1) * self.donl
                size = int.from_bytes(payload[at : at + 2], "big")
                self.held += START + payload[at + 2 : at + 2 + size]
                at += 2 + size
        elif kind == 49 and len(payload) >= 3:
            rest = payload[3 + 2 * self.donl :]
            if payload[2] & 0x80:
                self.fragment = True
                self.held += START + bytes([payload[0] & 0x81 | (payload[2] & 63) << 1, payload[1]]) + rest
            else:
                self.fragment = self.fragment and not payload[2] & 0x40
                self.held += rest
        else:
            self.held += START + payload
        done, self.held = ([self.held], b"") if marker else ([], self.held)
        return done


class JpegScans:
    """Scan data of RTP/JPEG images: fragment offset 0 begins an image, the marker ends it; packets before a beginning are lost."""

    def __init__(self, held: bytes = b"", fragment: bool = False):
        self.held, self.fragment = held, fragment

    def take(self, payload: bytes, marker: bool = False) -> list[bytes]:
        if len(payload) < 8:
            return []
        at = 8 + (4 if payload[4] & 0x40 else 0)
        if not int.from_bytes(payload[1:4], "big"):
            if payload[5] > 127:
                at += 4 + int.from_bytes(payload[at + 2 : at + 4], "big")
            self.held, self.fragment = b"", True
        if not self.fragment:
            return []
        self.held += payload[at:]
        if marker:
            done, self.held, self.fragment = [self.held], b"", False
            return done
        return []


class JpegImages(JpegScans):
    """Whole images: the scan data with a header from the fields of the first packet, and the end marker.

    Quantisation is that of a quality of 1 to 99, or tables of the stream, which are remembered for each number from 128 to 254.
    Images of unknown types, numbers or tables are lost.
    """

    def __init__(self, held: bytes = b"", fragment: bool = False, tables: dict[int, bytes] | None = None):
        super().__init__(held, fragment)
        self.head, self.tables = b"", tables or {}

    def take(self, payload: bytes, marker: bool = False) -> list[bytes]:
        done = super().take(payload, marker)
        if len(payload) < 8 or int.from_bytes(payload[1:4], "big"):
            return [self.head + x + b"\xff\xd9" for x in done]
        kind, number = payload[4] & 63, payload[5]
        restart = int.from_bytes(payload[8:10], "big") if payload[4] & 0x40 else 0
        at = 12 if payload[4] & 0x40 else 8
        own = payload[at + 4 : at + 4 + int.from_bytes(payload[at + 2 : at + 4], "big")] if number > 127 else b""
        if number > 127 and own and number < 255:
            self.tables[number] = own
        tables = quant_tables(number) if 1 <= number <= 99 else own or self.tables.get(number, b"")
        if kind > 1 or not tables:
            self.held, self.fragment = b"", False
            return []
        self.head = jfif_header(kind, payload[6] * 8, payload[7] * 8, restart, tables)
        return [self.head + x + b"\xff\xd9" for x in done]


MACHINES: dict[str, Callable] = {"h264": H264Units, "h265": H265Units, "jpeg": JpegScans, "jfif": JpegImages}


def units(packets: DataFrame, kind: str, stream: str, order: str, tail: bool = False, **options) -> DataFrame:
    """``stream, n, unit`` from ``stream, order, payload, marker``: complete units, and with ``tail`` what is left at the end of a stream.

    Streams pass through their task in order, a batch at a time; only the unfinished unit of one stream is held.
    """
    machine = MACHINES[kind]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, names = object(), None, 0, [stream, "n", "unit"]
        for batch in batches:
            out: list[tuple] = []
            for key, payload, marker in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    if tail and state is not None and state.held:
                        out.append((now, n, state.held))
                    now, state, n = key, machine(**options), 0
                for unit in state.take(payload.as_py() or b"", bool(marker)):
                    out.append((key, n, unit))
                    n += 1
            yield packed(batch.schema.field(0).type, out, names)
            last = batch.schema.field(0).type
        if tail and state is not None and state.held:
            yield packed(last, [(now, n, state.held)], names)

    def packed(kind_of: pa.DataType, out: list[tuple], names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind_of), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=names)

    rows = packets.repartition(stream).sortWithinPartitions(stream, order).select(stream, "payload", "marker")
    return rows.mapInArrow(fold, f"{stream} {dict(packets.dtypes)[stream]}, n int, unit binary")
