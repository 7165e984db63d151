"""Ordered analytics over packets and frames: islands, ranges, first and last, extended counters.

Every function takes the stream and order columns; all share one window specification, so that one shuffle and one sort
serve several of them in a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window(stream: str, order: str):
    return Window.partitionBy(stream).orderBy(order)


def carried(value: Column, at: Column, stream: str, order: str) -> Column:
    """The value of the latest row where ``at`` holds, that row included; its null counts as a value."""
    w = window(stream, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(at, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"]


def islands(df: DataFrame, inside: Column, stream: str, order: str) -> DataFrame:
    """Maximal runs of rows where ``inside`` holds: ``stream, segment (from 1), first, last, n``."""
    w = window(stream, order)
    rows = df.withColumn("__in", F.coalesce(inside, F.lit(False)))
    rows = rows.withColumn("__start", F.col("__in") & ~F.lag("__in", 1, False).over(w))
    rows = rows.withColumn("segment", F.sum(F.col("__start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__in")
    return rows.groupBy(stream, "segment").agg(F.min(order).alias("first_off"), F.max(order).alias("last_off"), F.count("*").alias("n"))


def range_between(df: DataFrame, start: Column, end: Column, stream: str, order: str) -> DataFrame:
    """Per stream the first row of ``start`` and the first later row of ``end``: ``stream, first_off, last_off, err``."""
    first = df.groupBy(stream).agg(F.min(F.when(start, F.col(order))).alias("first_off"))
    later = df.where(end).join(first, stream).where(F.col(order) > F.col("first_off")).groupBy(stream).agg(F.min(order).alias("last_off"))
    err = F.when(F.col("first_off").isNull(), "start not found").when(F.col("last_off").isNull(), "end not found")
    return first.join(later, stream, "left").select(stream, "first_off", "last_off", err.alias("err"))


def first_and_last(df: DataFrame, value: str, stream: str, order: str) -> DataFrame:
    """The values of the first and the last row of each stream, by order and not by size; a single row counts twice."""
    return df.groupBy(stream).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def pts_range(df: DataFrame, low: int | Column, high: int | Column, stream: str, order: str, pts: str = "pts") -> DataFrame:
    """Rows from the one that contains ``low`` to the one before the first at or after ``high``; the last row of a stream starts nothing."""
    after = F.lead(pts).over(window(stream, order))
    return df.withColumn("__after", after).where((F.col("__after") > low) & (F.col(pts) < high)).drop("__after")


def extended_sequence(df: DataFrame, sequence: str, stream: str, order: str, size: int = 65_536) -> DataFrame:
    """Adds ``cycles``, how often the sequence number has fallen so far, and ``extended_seq``, the number that never wraps."""
    w = window(stream, order)
    fell = F.coalesce((F.col(sequence) < F.lag(sequence).over(w)).cast("int"), F.lit(0))
    rows = df.withColumn("__fell", fell).withColumn("cycles", F.sum("__fell").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fell")
    return rows.withColumn("extended_seq", F.col("cycles") * size + F.col(sequence))
