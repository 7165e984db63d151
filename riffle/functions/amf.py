"""AMF0 values: objects as JSON text on one side and bytes on the other. Doubles need their bits, so this runs in Arrow batches."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# AMF0 type marks.
NUMBER, BOOLEAN, STRING, OBJECT, NULL, ECMA_ARRAY, OBJECT_END, STRICT_ARRAY, LONG_STRING = 0, 1, 2, 3, 5, 8, 9, 10, 12


def encode(value) -> bytes:
    if value is None:
        return bytes([NULL])
    if isinstance(value, bool):
        return bytes([BOOLEAN, value])
    if isinstance(value, (int, float)):
        return bytes([NUMBER]) + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return bytes([STRING]) + struct.pack(">H", len(raw)) + raw if len(raw) < 65_536 else bytes([LONG_STRING]) + struct.pack(">I", len(raw)) + raw
    if isinstance(value, list):
        return bytes([STRICT_ARRAY]) + struct.pack(">I", len(value)) + b"".join(map(encode, value))
    names = ((k.encode(), v) for k, v in value.items())
    return bytes([OBJECT]) + b"".join(struct.pack(">H", len(k)) + k + encode(v) for k, v in names) + bytes([0, 0, OBJECT_END])


def decode(data: bytes, at: int = 0):
    """The value at a place and the place behind it."""
    kind = data[at]
    if kind == NUMBER:
        return struct.unpack_from(">d", data, at + 1)[0], at + 9
    if kind == BOOLEAN:
        return bool(data[at + 1]), at + 2
    if kind in (STRING, LONG_STRING):
        n = 2 if kind == STRING else 4
        end = at + 1 + n + int.from_bytes(data[at + 1 : at + 1 + n], "big")
        if end > len(data):
            raise ValueError("short buffer")
        return data[at + 1 + n : end].decode(), end
    if kind == NULL:
        return None, at + 1
    if kind == STRICT_ARRAY:
        out, n, at = [], int.from_bytes(data[at + 1 : at + 5], "big"), at + 5
        for _ in range(n):
            v, at = decode(data, at)
            out.append(v)
        return out, at
    if kind not in (OBJECT, ECMA_ARRAY):
        raise ValueError(f"unknown type {kind}")
    found, at = {}, at + (5 if kind == ECMA_ARRAY else 1)
    while data[at : at + 3] != bytes([0, 0, OBJECT_END]):
        n = int.from_bytes(data[at : at + 2], "big")
        found[data[at + 2 : at + 2 + n].decode()], at = decode(data, at + 2 + n)
    return found, at + 3


def _to_bytes(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else encode(json.loads(v)))


def _to_text(values: pd.Series) -> pd.Series:
    def one(v):
        try:
            return None if v is None else json.dumps(decode(bytes(v))[0])
        except (ValueError, IndexError, struct.error, UnicodeDecodeError):
            return None

    return values.map(one)


def from_json(text: Column | str) -> Column:
    """JSON text to AMF0; null stays null."""
    return F.pandas_udf(_to_bytes, "binary")(text)


def to_json(data: Column | str) -> Column:
    """AMF0 to JSON text; null for bytes that are no value."""
    return F.pandas_udf(_to_text, "string")(data)
