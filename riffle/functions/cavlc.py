"""Variable-length coded residuals of H.264: coefficient tokens chosen by what the neighbours hold, levels, and their places by runs.

Decoding reads all blocks of a batch at once with the cursor of ``riffle.functions.units``; a token is one look into a table of
the next 16 bits. Blocks are written all at once too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

from riffle.functions.units import ERRORS, Cursor

# Codes of (trailing ones, coefficients) in the order (0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2), (0, 3) and so on, for
# neighbours that hold less than 2, 4 and 8 coefficients, and for the DC of chroma in 4:2:0 and 4:2:2.
TOKENS_UNDER_2 = (
    "1", "000101", "01", "00000111", "000100", "001", "000000111", "00000110", "0000101", "00011", "0000000111", "000000110", "00000101", "000011", "00000000111", "0000000110",
    "000000101", "0000100", "0000000001111", "00000000110", "0000000101", "00000100", "0000000001011", "0000000001110", "00000000101", "000000100", "0000000001000",
    "0000000001010", "0000000001101", "0000000100", "00000000001111", "00000000001110", "0000000001001", "00000000100", "00000000001011", "00000000001010", "00000000001101",
    "0000000001100", "000000000001111", "000000000001110", "00000000001001", "00000000001100", "000000000001011", "000000000001010", "000000000001101", "00000000001000",
    "0000000000001111", "000000000000001", "000000000001001", "000000000001100", "0000000000001011", "0000000000001110", "0000000000001101", "000000000001000", "0000000000000111",
    "0000000000001010", "0000000000001001", "0000000000001100", "0000000000000100", "0000000000000110", "0000000000000101", "0000000000001000",
)
TOKENS_UNDER_4 = (
    "11", "001011", "10", "000111", "00111", "011", "0000111", "001010", "001001", "0101", "00000111", "000110", "000101", "0100", "00000100", "0000110", "0000101", "00110",
    "000000111", "00000110", "00000101", "001000", "00000001111", "000000110", "000000101", "000100", "00000001011", "00000001110", "00000001101", "0000100", "000000001111",
    "00000001010", "00000001001", "000000100", "000000001011", "000000001110", "000000001101", "00000001100", "000000001000", "000000001010", "000000001001", "00000001000",
    "0000000001111", "0000000001110", "0000000001101", "000000001100", "0000000001011", "0000000001010", "0000000001001", "0000000001100", "0000000000111", "00000000001011",
    "0000000000110", "0000000001000", "00000000001001", "00000000001000", "00000000001010", "0000000000001", "00000000000111", "00000000000110", "00000000000101", "00000000000100",
)
TOKENS_UNDER_8 = (
    "1111", "001111", "1110", "001011", "01111", "1101", "001000", "01100", "01110", "1100", "0001111", "01010", "01011", "1011", "0001011", "01000", "01001", "1010", "0001001",
    "001110", "001101", "1001", "0001000", "001010", "001001", "1000", "00001111", "0001110", "0001101", "01101", "00001011", "00001110", "0001010", "001100", "000001111",
    "00001010", "00001101", "0001100", "000001011", "000001110", "00001001", "00001100", "000001000", "000001010", "000001101", "00001000", "0000001101", "000000111", "000001001",
    "000001100", "0000001001", "0000001100", "0000001011", "0000001010", "0000000101", "0000001000", "0000000111", "0000000110", "0000000001", "0000000100", "0000000011",
    "0000000010",
)
TOKENS_CHROMA_420 = (
    "01", "000111", "1", "000100", "000110", "001", "000011", "0000011", "0000010", "000101", "000010", "00000011", "00000010", "0000000",
)
TOKENS_CHROMA_422 = (
    "1", "0001111", "01", "0001110", "0001101", "001", "000000111", "0001100", "0001011", "00001", "000000110", "000000101", "0001010", "000001", "0000000111", "0000000110",
    "000000100", "0001001", "00000000111", "00000000110", "0000000101", "0001000", "000000000111", "000000000110", "00000000101", "0000000100", "0000000000111", "000000000101",
    "000000000100", "00000000100",
)
#: Bits of a token at most; the class of six-bit tokens follows a rule.
LONGEST = 16
#: Sizes of suffixes grow to this.
LONGEST_SUFFIX = 6


def token_pairs(most: int) -> list[tuple[int, int]]:
    """(trailing ones, coefficients) in the order of the tables."""
    return [(ones, total) for total in range(most + 1) for ones in range(min(3, total) + 1)]


def six_bit_tokens() -> tuple[str, ...]:
    """Tokens beside 8 coefficients or more: the coefficients less one and the trailing ones; 000011 for none."""
    return tuple(f"{total - 1:04b}{ones:02b}" if total else "000011" for ones, total in token_pairs(16))


#: Tokens of each class, and the coefficients that it reaches.
CLASSES = ((TOKENS_UNDER_2, 16), (TOKENS_UNDER_4, 16), (TOKENS_UNDER_8, 16), (six_bit_tokens(), 16), (TOKENS_CHROMA_420, 4), (TOKENS_CHROMA_422, 8))


def token_tables() -> np.ndarray:
    """Of each class and each 16 bits: length of the token that they begin with, trailing ones, coefficients; length 0 where there is none."""
    out = np.zeros((len(CLASSES), 1 << LONGEST, 3), np.int64)
    for i, (codes, most) in enumerate(CLASSES):
        for code, (ones, total) in zip(codes, token_pairs(most), strict=True):
            first = int(code, 2) << LONGEST - len(code)
            out[i, first : first + (1 << LONGEST - len(code))] = len(code), ones, total
    return out


def context_number(available_a: Column, n_a: Column, available_b: Column, n_b: Column) -> Column:
    """Coefficients that a block is expected to have: those of the blocks to the left and above, as far as they are available."""
    both = F.shiftright((n_a + n_b + 1).cast("int"), 1)
    return F.when(available_a & available_b, both).when(available_a, n_a).when(available_b, n_b).otherwise(0).cast("int")


def neighbour_coefficients(pcm: Column, skipped: Column, total: Column) -> Column:
    """What a neighbour counts as: 16 without coding, 0 where it was skipped or its residual is all zero."""
    return F.when(pcm, 16).when(skipped, 0).otherwise(total)


def token_class(nc: np.ndarray) -> np.ndarray:
    """Place in ``CLASSES``; -1 for an invalid context number."""
    return np.select([nc == -1, nc == -2, nc < 0, nc < 2, nc < 4, nc < 8], [4, 5, -1, 0, 1, 2], 3)


def bit_strings(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each row, its numbers as so many bits one after another, filled up to whole bytes."""
    n = sizes.sum(axis=1)
    start = 8 * np.append(0, np.cumsum(-(-n // 8)))
    flat = sizes.ravel()
    piece = np.repeat(np.arange(len(flat)), flat)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(flat) - flat, flat)
    bits = np.zeros(int(start[-1]), np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    bits[np.repeat(start[:-1], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = values.ravel()[piece] >> (flat[piece] - 1 - within) & 1
    packed = np.packbits(bits).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(start.tolist(), start[1:].tolist(), strict=False)]


def write_blocks(nc: np.ndarray, ones: np.ndarray, levels: np.ndarray, total: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Token, signs of trailing ones and levels of each block, with a stop bit; and the blocks that have no code.

    A level is a unary prefix and a suffix whose size follows the levels before it; large ones are escaped.
    """
    levels = np.concatenate([levels, np.zeros((len(nc), max(0, 16 - levels.shape[1])), np.int64)], axis=1)
    kind, rows = token_class(nc), np.arange(len(nc))
    most = np.array([c[1] for c in CLASSES])[kind]
    bad = (kind < 0) | (total > most) | (ones < 0) | (ones > np.minimum(total, 3))
    ones, total = np.where(bad, 0, ones), np.where(bad, 0, total)
    at = np.where(total < 3, total * (total + 1) // 2, 6 + 4 * (total - 3)) + ones
    codes = np.array([[(int(c, 2), len(c)) for c in [*codes, *["0"] * (62 - len(codes))]] for codes, _ in CLASSES])[kind, at]
    values, sizes = np.zeros((len(nc), 37), np.int64), np.zeros((len(nc), 37), np.int64)
    values[:, 0], sizes[:, 0] = codes[:, 0], codes[:, 1]
    for j in range(3):
        now = j < ones
        values[now, 1 + j], sizes[now, 1 + j] = levels[now, j] < 0, 1
        bad |= now & (np.abs(levels[:, j]) != 1)
    size = np.where((total > 10) & (ones < 3), 1, 0)
    for j in range(16):
        now = ones + j < total
        v = np.where(now, levels[rows, np.minimum(ones + j, 15)], 1)
        code = np.where(v > 0, 2 * v - 2, -2 * v - 1) - np.where((j == 0) & (ones < 3), 2, 0)
        bad |= now & ((v == 0) | (code < 0))
        code = np.maximum(code, 0)
        escape = np.where(size == 0, 30, 15 << size)
        prefix = np.where(code >= escape, 15, np.where(size == 0, np.minimum(code, 14), code >> size))
        left = np.where(code >= escape, code - escape, np.where((size == 0) & (code >= 14), code - 14, code & (1 << size) - 1))
        wide = np.where(code >= escape, 12, np.where((size == 0) & (code >= 14), 4, size))
        while (more := now & (code >= escape) & (left >= 1 << np.minimum(wide, 40)) & (wide < 29)).any():  # longer escapes: each step holds twice as many, behind the shorter ones
            left, wide, prefix = np.where(more, left - (1 << wide), left), wide + more, prefix + more
        bad |= now & (left >= 1 << wide)
        values[now, 4 + 2 * j], sizes[now, 4 + 2 * j] = 1, prefix[now] + 1
        values[now, 5 + 2 * j], sizes[now, 5 + 2 * j] = left[now], wide[now]
        size = np.where(now, np.maximum(size, 1), size)
        size += now & (np.abs(v) > 3 << np.maximum(size - 1, 0)) & (size < LONGEST_SUFFIX)
    values[:, 36], sizes[:, 36] = 1, 1
    return bit_strings(values, sizes), bad


def written(nc: Column, ones: Column, levels: Column) -> Column:
    """Bytes of a block; null where its numbers have no code: zero levels, trailing ones other than 1 and -1, or more coefficients than the class has."""

    @F.arrow_udf("binary")
    def run(numbers: pa.Array, trailing: pa.Array, lists: pa.Array) -> pa.Array:
        total = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        level = np.zeros((len(total), max(1, int(total.max(initial=0)))), np.int64)
        level[np.arange(level.shape[1])[None] < total[:, None]] = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False)
        number = lambda a: a.fill_null(-9).to_numpy(zero_copy_only=False).astype(np.int64)
        out, bad = write_blocks(number(numbers), number(trailing), level[:, :16], total)
        return pa.array([None if x else b for x, b in zip(bad.tolist(), out, strict=True)], pa.binary())

    return run(nc.cast("int"), ones.cast("int"), levels.cast("array<int>"))


def read_block(cursor: Cursor, nc: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trailing ones, coefficients and levels (16 columns) of one block of each unit."""
    kind = token_class(nc)
    cursor.fault[(kind < 0) & (cursor.fault == 0)] = ERRORS.index("invalid context number")
    ones, total = cursor.lookup(tables, kind)
    levels = np.zeros((len(nc), 16), np.int64)
    for j in range(3):
        now = (j < ones) & (cursor.fault == 0)
        levels[now, j] = (1 - 2 * cursor.bits("", 1, now))[now]
    size = np.where((total > 10) & (ones < 3), 1, 0)
    for j in range(16):
        now = (ones + j < total) & (cursor.fault == 0)
        if not now.any():
            break
        prefix = cursor.zeros(now)
        suffix = cursor.bits("", np.where(prefix >= 15, prefix - 3, np.where((prefix == 14) & (size == 0), 4, size)), now)
        code = (np.minimum(prefix, 15) << size) + suffix
        code += np.where((prefix >= 15) & (size == 0), 15, 0) + np.where(prefix >= 16, (1 << np.maximum(prefix - 3, 0)) - 4096, 0)
        code += np.where((j == 0) & (ones < 3), 2, 0)
        value = np.where(code % 2 == 0, (code + 2) >> 1, (-code - 1) >> 1)
        now &= cursor.fault == 0
        levels[now, (ones + j)[now]] = value[now]
        size = np.where(now, np.maximum(size, 1), size)
        size += now & (np.abs(value) > 3 << np.maximum(size - 1, 0)) & (size < LONGEST_SUFFIX)
    return ones, total, levels


def residual(data: Column, nc: Column) -> Column:
    """``ones, total, levels, n_bits, err`` of the block that begins the bytes; ``nc`` is its context number."""

    @F.arrow_udf("struct<ones:int, total:int, levels:array<int>, n_bits:int, err:string>")
    def run(blocks: pa.Array, numbers: pa.Array) -> pa.Array:
        cursor = Cursor(blocks)
        ones, total, levels = read_block(cursor, numbers.fill_null(-3).to_numpy(zero_copy_only=False).astype(np.int64), token_tables())
        bad = cursor.fault != 0
        n = np.where(bad, 0, total)
        held = np.arange(16)[None] < n[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(levels[held].astype(np.int32)))
        number = lambda v: pa.array(v.astype(np.int32), mask=bad)
        return pa.StructArray.from_arrays([number(ones), number(total), lists, number(cursor.at), pa.array(ERRORS, pa.string()).take(pa.array(cursor.fault))], names=["ones", "total", "levels", "n_bits", "err"])

    return run(data, nc.cast("int"))


def coefficients(levels: Column, runs: Column) -> Column:
    """Coefficients in scan order: the last level comes first, each behind its run of zeros."""
    place = lambda i: F.aggregate(F.slice(runs, i + 1, F.size(runs)), F.lit(-1), lambda a, r: (a + r + 1).cast("int"))
    places = F.transform(levels, lambda _, i: place(i))
    found = F.transform(F.sequence(F.lit(0), place(F.lit(0))), lambda p: F.coalesce(F.get(levels, (F.array_position(places, p) - 1).cast("int")), F.lit(0)))
    return F.when(F.size(levels) > 0, found).otherwise(F.array().cast("array<int>"))
