"""Column builders for bytes and bits. Numbers that would be unsigned are widened; packers give upper-case hex text, ``unhex`` makes it binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u8(data: Column, at: int | Column) -> Column:
    """The byte at ``at`` (from 0); null beyond the end."""
    return be(data, at, 1)


def be(data: Column, at: int | Column, n: int) -> Column:
    """``n`` bytes as a big-endian unsigned number; null where they are not all there. n is 7 at most."""
    part = F.substring(data, (at if isinstance(at, Column) else F.lit(at)) + 1, F.lit(n))
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def le(data: Column, at: int | Column, n: int) -> Column:
    """``n`` bytes as a little-endian unsigned number."""
    first = at if isinstance(at, Column) else F.lit(at)
    total = u8(data, first)
    for i in range(1, n):
        total = total + F.shiftleft(u8(data, first + i), 8 * i)
    return total


def signed(v: Column, bits: int) -> Column:
    return F.when(v >= 1 << (bits - 1), v - (1 << bits)).otherwise(v)


def put_be(v: Column, n: int) -> Column:
    """A number as ``n`` big-endian bytes in hex; higher bits are cut off."""
    return F.right(F.lpad(F.hex(v.cast("long")), F.lit(16), F.lit("0")), F.lit(2 * n))


def put_le(v: Column, n: int) -> Column:
    whole = put_be(v, n)
    return F.concat(*[F.substring(whole, 2 * (n - 1 - i) + 1, 2) for i in range(n)])


def octets(data: Column) -> Column:
    """The bytes as an array of numbers."""
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_mpeg2(data: Column) -> Column:
    """CRC-32 with polynomial 04C11DB7, start FFFFFFFF, not reflected and not inverted: the one of PSI sections. A byte at a time."""
    steps = F.array(*map(F.lit, _crc_table())).cast("array<bigint>")

    def byte(c: Column, b: Column) -> Column:
        at = F.shiftright(c, 24).bitwiseXOR(b.cast("long")).cast("int")
        return F.shiftleft(c, 8).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.get(steps, at))

    return F.aggregate(octets(data), F.lit(0xFFFFFFFF).cast("long"), byte)


def chunks(data: Column, n: int) -> Column:
    """The bytes in pieces of ``n``, the last one perhaps shorter; none for empty bytes."""
    if n <= 0:
        raise ValueError(f"chunk size must be positive, not {n}")
    count = F.ceil(F.octet_length(data) / n).cast("int")
    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(data, i * n + 1, F.lit(n)))


def latin1(data: Column) -> Column:
    """Bytes as text of the same length, one character for each, for regular expressions over bytes."""
    return F.decode(data, "ISO-8859-1")


def from_latin1(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def split_after(data: Column, delimiter: int) -> Column:
    """Pieces up to and including each delimiter byte, and the rest."""
    d = f"\\x{delimiter:02x}"
    return F.transform(F.regexp_extract_all(latin1(data), F.lit(f"(?s)[^{d}]*{d}|[^{d}]+$"), F.lit(0)), from_latin1)


def padded(data: Column, size: int, fill: int = 0xFF) -> Column:
    """Filled up to ``size`` bytes; longer bytes stay."""
    more = F.greatest(F.lit(0), F.lit(size) - F.octet_length(data))
    return F.concat(data, F.unhex(F.repeat(F.lit(f"{fill:02X}"), more)))


def bits(data: Column) -> Column:
    """The bits as text, first bit first."""
    return F.array_join(F.transform(octets(data), lambda b: F.lpad(F.bin(b), 8, "0")), "")
