"""Context-adaptive binary arithmetic coding of H.264: ranges, states, and a coder that moves through many rows at once.

A row has its bins and, for each, the number of a context of the row, ``BYPASS`` or ``TERMINATE``. Contexts start from the states
that ``context_state`` gives. The table of the numbers m and n, from which these follow for each context and kind of slice, is
a parameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions.h264 import context_state
from riffle.functions.units import ERRORS, Cursor

BYPASS, TERMINATE = -1, -2
STATES, QUARTERS = 64, 4
#: Contexts of a table of m and n, and kinds of slices: 0 for I, 1 to 3 for the others.
CONTEXTS, KINDS = 1_024, 4


def range_table() -> np.ndarray:
    """The range that the less probable symbol gets in each state and quarter of the range.

    A state's probability falls from 0.5 by a constant factor, to 0.01875 in the 63rd step; it is multiplied with a range in
    the middle of the quarter and rounded, to 6 at least and 128 at most in the lowest quarter. The last state is for termination and has 2.
    """
    falls = 0.5 * (0.01875 / 0.5) ** (np.arange(STATES - 1) / 63)
    middle = 286.9 + 64.13 * np.arange(QUARTERS)
    out = np.maximum(6, np.rint(falls[:, None] * middle)).astype(np.int64)
    out[:, 0] = np.minimum(out[:, 0], 128)
    return np.concatenate([out, np.full((1, QUARTERS), 2)])


# The state that follows each state when the less probable symbol comes.
AFTER_LESS = (
    0, 0, 1, 2, 2, 4, 4, 5, 6, 7, 8, 9, 9, 11, 11, 12, 13, 13, 15, 15, 16, 16, 18, 18, 19, 19, 21, 21, 22, 22, 23, 24,
    24, 25, 26, 26, 27, 27, 28, 29, 29, 30, 30, 30, 31, 32, 32, 33, 33, 33, 34, 34, 35, 35, 35, 36, 36, 36, 37, 37, 37, 38, 38, 63,
)


def after_more(state: int) -> int:
    """The state that follows when the more probable symbol comes."""
    return min(state + 1, 62) if state < 63 else 63


def range_of_less(state: Column, quarter: Column) -> Column:
    """``range, err``: a look into the range table."""
    table = F.array(*[F.array(*[F.lit(int(v)) for v in row]) for row in range_table()])
    fine = lambda v, n: (v >= 0) & (v < n)
    err = F.when(~fine(state, STATES), "invalid state").when(~fine(quarter, QUARTERS), "invalid quarter")
    return F.struct(F.when(err.isNull(), F.get(F.get(table, state.cast("int")), quarter.cast("int"))).alias("range"), err.alias("err"))


def split_state(pre: Column) -> dict[str, Column]:
    """State and more probable symbol of a starting state of 1 to 126."""
    return {"state": F.when(pre <= 63, 63 - pre).otherwise(pre - 64).cast("int"), "mps": F.when(pre <= 63, 0).when(pre > 63, 1)}


def context_init(slices: DataFrame, numbers: DataFrame, kind: str = "kind", qp: str = "qp", context: str = "ctx") -> DataFrame:
    """``slices`` with ``m, n, pre, state, mps`` of a context each. ``numbers`` has ``ctx, kind, m, n``, one row for each context and kind.

    The table has ``CONTEXTS * KINDS`` rows at most and is sent to all tasks; more rows, or two for one context, are refused.
    """
    known = numbers.select(F.col("ctx").cast("int").alias(context), F.col("kind").cast("int").alias(kind), F.col("m").cast("int"), F.col("n").cast("int"))
    known = known.where(F.col(context).between(0, CONTEXTS - 1) & F.col(kind).between(0, KINDS - 1))
    total, distinct = known.agg(F.count("*"), F.count_distinct(context, kind)).first()
    if total != distinct:
        raise ValueError(f"the table of m and n has {total - distinct} rows for contexts that have one already")
    out = slices.join(F.broadcast(known), [context, kind], "left").withColumn("pre", F.when(F.col("m").isNotNull() & F.col("n").isNotNull(), context_state(F.col("m"), F.col("n"), F.col(qp)).cast("int")))
    return out.withColumns(split_state(F.col("pre")))


class Contexts:
    """States and more probable symbols of the contexts of many rows."""

    def __init__(self, pre: np.ndarray):
        self.state = np.where(pre <= 63, 63 - pre, pre - 64)
        self.mps = (pre > 63).astype(np.int64)
        self.table, self.less, self.more = range_table(), np.array(AFTER_LESS), np.array([after_more(s) for s in range(STATES)])

    def step(self, rows: np.ndarray, ctx: np.ndarray, less: np.ndarray) -> None:
        state = self.state[rows, ctx]
        self.mps[rows, ctx] ^= less & (state == 0)
        self.state[rows, ctx] = np.where(less, self.less[state], self.more[state])


def _matrix(lists: pa.Array, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of one width, and their lengths."""
    n = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(lists), int(n.max(initial=0))), fill, np.int64)
    out[np.arange(out.shape[1])[None] < n[:, None]] = lists.flatten().fill_null(fill).to_numpy(zero_copy_only=False)
    return out, n


def _renormed(span: np.ndarray) -> np.ndarray:
    """Shifts that bring a range back to 9 bits."""
    return 9 - np.frexp(span.astype(float))[1]


def encode(bins: np.ndarray, ctx: np.ndarray, n: np.ndarray, pre: np.ndarray) -> list[bytes]:
    """Bytes of the bins of each row, with a terminating bin behind them.

    The code of a row is a sum: each bin that takes the upper part of the range adds the lower part at the place of its last bit.
    The sums are kept unnormalised, one cell for each bit, and the carries are passed on once at the end.
    """
    contexts = Contexts(pre)
    span, at = np.full(len(n), 510), np.zeros(len(n), np.int64)
    cells = np.zeros((len(n), 9 + 8 * (bins.shape[1] + 2)), np.int64)
    for j in range(bins.shape[1] + 1):
        rows = np.flatnonzero(n >= j)
        last = n[rows] == j
        kind = np.where(last, TERMINATE, ctx[rows, min(j, bins.shape[1] - 1)] if bins.shape[1] else TERMINATE)
        bit = np.where(last, 1, bins[rows, min(j, bins.shape[1] - 1)] if bins.shape[1] else 1)
        own = kind >= 0
        c = np.maximum(kind, 0)
        less_span = np.where(own, contexts.table[contexts.state[rows, c], span[rows] >> 6 & 3], 2) if pre.shape[1] else np.full(len(rows), 2)
        upper = np.where(own, bit != contexts.mps[rows, c], bit == 1) if pre.shape[1] else bit == 1
        by = kind == BYPASS
        # a bypass bin halves the range: twice the scale and the range as it was
        at[rows] += by
        low = np.where(by, span[rows], span[rows] - less_span)
        np.add.at(cells, (rows[upper], 8 + at[rows][upper]), low[upper])
        span[rows] = np.where(by, span[rows], np.where(upper, less_span, span[rows] - less_span))
        contexts.step(rows[own], c[own], upper[own].astype(np.int64))
        shift = np.where(by, 0, _renormed(span[rows]))
        span[rows] <<= shift
        at[rows] += shift
    for i in range(cells.shape[1] - 1, 0, -1):
        cells[:, i - 1] += cells[:, i] >> 1
        cells[:, i] &= 1
    out = []
    for row, end in zip(cells, (at + 2).tolist(), strict=True):
        row[end - 1] = 1  # the last bit written is the stop bit
        out.append(np.packbits(row[:end].astype(np.uint8)).tobytes())
    return out


def decode(cursor: Cursor, ctx: np.ndarray, n: np.ndarray, pre: np.ndarray) -> np.ndarray:
    """Bins of each row, one for each entry of ``ctx``."""
    contexts = Contexts(pre)
    span, offset = np.full(len(n), 510), cursor.bits("", 9, cursor.all)
    bins = np.zeros(ctx.shape, np.int64)
    for j in range(ctx.shape[1]):
        rows = np.flatnonzero((n > j) & (cursor.fault == 0))
        kind = ctx[rows, j]
        own, by, end = kind >= 0, kind == BYPASS, kind == TERMINATE
        c = np.maximum(kind, 0)
        less_span = np.where(own, contexts.table[contexts.state[rows, c], span[rows] >> 6 & 3], 2) if pre.shape[1] else np.full(len(rows), 2)
        take = np.zeros(len(n), np.int64)
        take[rows[by]] = 1
        offset = np.where(take == 1, offset << 1 | cursor.bits("", 1, take == 1), offset)
        left = np.where(by, span[rows], span[rows] - less_span)
        upper = offset[rows] >= left
        offset[rows] -= np.where(upper & ~end, left, 0)
        span[rows] = np.where(by, span[rows], np.where(upper & ~end, less_span, left))
        mps = contexts.mps[rows, c] if pre.shape[1] else np.zeros(len(rows), np.int64)
        bins[rows, j] = np.where(own, mps ^ upper, upper)
        contexts.step(rows[own], c[own], upper[own].astype(np.int64))
        shift = np.zeros(len(n), np.int64)
        shift[rows] = np.where(by | (end & upper), 0, _renormed(span[rows]))
        span <<= shift
        more = cursor.bits("", shift, shift > 0)
        offset = np.where(shift > 0, offset << shift | more, offset)
    return bins


def _states(pre: pa.Array, ctx: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States of each row, and the rows whose states or contexts are invalid."""
    states, given = _matrix(pre, 1)
    inside = np.arange(states.shape[1])[None] < given[:, None]
    bad = (((states < 1) | (states > 126)) & inside).any(axis=1)
    used = np.where(np.arange(ctx.shape[1])[None] < n[:, None], ctx, BYPASS)
    bad |= (used.max(axis=1, initial=BYPASS) >= given) | (used.min(axis=1, initial=BYPASS) < TERMINATE)
    return np.where(bad[:, None], 1, states), bad


def encoded_bins(bins: Column, ctx: Column, pre: Column) -> Column:
    """Bytes of the bins (0 and 1), coded with the contexts ``ctx`` that start from the states ``pre``; null for invalid states or contexts."""

    @F.arrow_udf("binary")
    def run(values: pa.Array, contexts: pa.Array, starts: pa.Array) -> pa.Array:
        c, n = _matrix(contexts, BYPASS)
        b, _ = _matrix(values, 0)
        b = np.concatenate([b, np.zeros((len(b), max(0, c.shape[1] - b.shape[1])), np.int64)], axis=1)[:, : c.shape[1]]
        states, bad = _states(starts, c, n)
        return pa.array([None if x else y for x, y in zip(bad.tolist(), encode(b & 1, np.where(bad[:, None], BYPASS, c), n, states), strict=True)], pa.binary())

    return run(bins.cast("array<int>"), ctx.cast("array<int>"), pre.cast("array<int>"))


def decoded_bins(data: Column, ctx: Column, pre: Column) -> Column:
    """``bins, n_bits, err``: as many bins as ``ctx`` has entries; no bins where the bytes end early or a state or context is invalid."""

    @F.arrow_udf("struct<bins:array<int>, n_bits:int, err:string>")
    def run(values: pa.Array, contexts: pa.Array, starts: pa.Array) -> pa.Array:
        c, n = _matrix(contexts, BYPASS)
        states, bad = _states(starts, c, n)
        cursor = Cursor(values)
        cursor.fault[bad] = ERRORS.index("invalid state")
        bins = decode(cursor, np.where(bad[:, None], BYPASS, c), n, states)
        n = np.where(cursor.fault != 0, 0, n)
        held = np.arange(c.shape[1])[None] < n[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(bins[held].astype(np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(cursor.at.astype(np.int32)), pa.array(ERRORS, pa.string()).take(pa.array(cursor.fault))], names=["bins", "n_bits", "err"])

    return run(data, ctx.cast("array<int>"), pre.cast("array<int>"))
