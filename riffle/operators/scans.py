"""Ordered analytics over streams that are longer than a task: prefix scans in two levels.

Rows are dealt to blocks by ranges of stream and order, so a long stream lies in many blocks, one behind the other. Every running
value is found in three steps: what a block gives as a whole (a sum, a last value), carried over the few rows that stand for
the blocks of a stream; a window inside each block; and a join that adds the one to the other. No window spans a stream.

Several scans over the same blocks share their shuffle: windows and joins all have the key (stream, block).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.session import cut

BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """A running value: in a block (over its window), of a block (an aggregate of rows in ``order``), carried to a block (over the blocks of a stream), and both together."""

    inside: Callable[[object], Column]
    whole: Callable[[str], Column]
    carried: Callable[[Column, object], Column]
    merged: Callable[[Column, Column], Column]


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def total(value: Column) -> Running:
    """The sum up to and with each row; null before the first value."""
    both = lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return Running(lambda w: F.sum(value).over(_so_far(w)), lambda _: F.sum(value), lambda c, w: F.sum(c).over(_before(w)), both)


def number() -> Running:
    """Rows before each row."""
    return Running(lambda w: F.row_number().over(w) - 1, lambda _: F.count("*"), lambda c, w: F.sum(c).over(_before(w)), lambda a, b: a + F.coalesce(b, F.lit(0)))


def latest(value: Column, at: Column) -> Running:
    """The value of the latest row where ``at`` holds, that row included; its null counts as a value."""
    kept = F.struct(value.alias("v"))
    return Running(
        lambda w: F.last(F.when(at, kept), ignorenulls=True).over(_so_far(w)), lambda order: F.max_by(kept, F.when(at, F.col(order))), lambda c, w: F.last(c, ignorenulls=True).over(_before(w)), lambda a, b: F.coalesce(a, b)["v"]
    )


def previous(value: Column) -> Running:
    """The value of the row before; null for the first row."""
    kept = F.struct(value.alias("v"))
    return Running(lambda w: F.lag(kept).over(w), lambda order: F.max_by(kept, order), lambda c, w: F.lag(c).over(w), lambda a, b: F.coalesce(a, b)["v"])


def following(value: Column) -> Running:
    """The value of the row behind; null for the last row."""
    kept = F.struct(value.alias("v"))
    return Running(lambda w: F.lead(kept).over(w), lambda order: F.min_by(kept, order), lambda c, w: F.lead(c).over(w), lambda a, b: F.coalesce(a, b)["v"])


def first(value: Column) -> Running:
    """The value of the first row of the stream."""
    kept = F.struct(value.alias("v"))
    return Running(lambda w: F.first(kept).over(w), lambda order: F.min_by(kept, order), lambda c, w: F.first(c).over(w), lambda _, b: b["v"])


def blocked(df: DataFrame, stream: str, order: str, blocks: int | None = None) -> DataFrame:
    """``df`` dealt to ``blocks`` blocks (as many as the session shuffles to, unless named), kept in the shared folder. The order of a stream must have no ties or nulls."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, F.col(stream), F.col(order)).withColumn(BLOCK, F.spark_partition_id()))


def scan(rows: DataFrame, stream: str, order: str, **running: Running) -> DataFrame:
    """Adds a column for each running value. ``rows`` come from ``blocked``."""
    names = list(running)
    wholes = rows.groupBy(stream, BLOCK).agg(*[running[n].whole(order).alias(n) for n in names])
    heads = Window.partitionBy(stream).orderBy(BLOCK)  # one row for each block of a stream
    heads = wholes.select(F.col(stream).alias("__stream"), F.col(BLOCK).alias("__at"), *[running[n].carried(F.col(n), heads).alias(f"__head_{n}") for n in names])
    w = Window.partitionBy(stream, BLOCK).orderBy(order)
    inside = rows.select("*", *[running[n].inside(w).alias(f"__in_{n}") for n in names])
    joined = inside.join(heads, F.col(stream).eqNullSafe(F.col("__stream")) & (F.col(BLOCK) == F.col("__at")))
    return joined.select(*[f"`{c}`" for c in rows.columns], *[running[n].merged(F.col(f"__in_{n}"), F.col(f"__head_{n}")).alias(n) for n in names])


def islands(df: DataFrame, inside: Column, stream: str, order: str, blocks: int | None = None) -> DataFrame:
    """As ``ordered.islands``: maximal runs of rows where ``inside`` holds."""
    rows = blocked(df.withColumn("__in", F.coalesce(inside, F.lit(False))), stream, order, blocks)
    return runs(rows, stream, order)


def runs(rows: DataFrame, stream: str, order: str) -> DataFrame:
    """``stream, segment, first_off, last_off, n`` of blocked rows with a flag ``__in``."""
    rows = scan(rows, stream, order, __was=previous(F.col("__in")))
    start = F.col("__in") & ~F.coalesce("__was", F.lit(False))
    rows = scan(rows.withColumn("__start", start.cast("int")), stream, order, segment=total(F.col("__start"))).where("__in")
    return rows.groupBy(stream, "segment").agg(F.min(order).alias("first_off"), F.max(order).alias("last_off"), F.count("*").alias("n"))


def carried_islands(df: DataFrame, value: Column, at: Column, inside: Callable[[Column], Column], stream: str, order: str, blocks: int | None = None) -> DataFrame:
    """Runs of rows where ``inside`` holds for the value that the latest row with ``at`` has: the segments of some metadata."""
    rows = scan(blocked(df, stream, order, blocks), stream, order, __now=latest(value, at))
    return runs(rows.withColumn("__in", F.coalesce(inside(F.col("__now")), F.lit(False))), stream, order)


def extended_sequence(df: DataFrame, sequence: str, stream: str, order: str, size: int = 65_536, blocks: int | None = None) -> DataFrame:
    """As ``ordered.extended_sequence``: adds ``cycles`` and ``extended_seq``."""
    rows = scan(blocked(df, stream, order, blocks), stream, order, __was=previous(F.col(sequence)))
    rows = rows.withColumn("__fell", F.coalesce((F.col(sequence) < F.col("__was")).cast("int"), F.lit(0)))
    rows = scan(rows, stream, order, cycles=total(F.col("__fell")))
    return rows.select(*df.columns, "cycles", (F.col("cycles") * size + F.col(sequence)).alias("extended_seq"))


def with_discontinuity(df: DataFrame, stream: str = "pid", order: str = "off", cc: str = "cc", modulus: int = 16, blocks: int | None = None) -> DataFrame:
    """As ``continuity.with_discontinuity``: adds ``expected_cc`` and ``discontinuous``."""
    rows = scan(blocked(df, stream, order, blocks), stream, order, __was=previous(F.col(cc)))
    expected = F.pmod(F.col("__was") + 1, F.lit(modulus))
    return rows.select(*df.columns, expected.alias("expected_cc"), F.coalesce(F.col(cc) != expected, F.lit(False)).alias("discontinuous"))


def with_repaired_cc(df: DataFrame, stream: str = "pid", order: str = "off", cc: str = "cc", modulus: int = 16, blocks: int | None = None) -> DataFrame:
    """Adds ``repaired_cc``, as ``continuity.repaired_cc`` gives it."""
    rows = scan(blocked(df, stream, order, blocks), stream, order, __first=first(F.col(cc)), __n=number())
    return rows.select(*df.columns, F.pmod(F.col("__first") + F.col("__n"), F.lit(modulus)).alias("repaired_cc"))


def pts_range(df: DataFrame, low: int | Column, high: int | Column, stream: str, order: str, pts: str = "pts", blocks: int | None = None) -> DataFrame:
    """As ``ordered.pts_range``."""
    rows = scan(blocked(df, stream, order, blocks), stream, order, __after=following(F.col(pts)))
    return rows.where((F.col("__after") > low) & (F.col(pts) < high)).select(*df.columns)
