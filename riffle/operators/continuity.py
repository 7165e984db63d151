"""Continuity counters of packet streams: 4-bit counters that advance by one for each packet of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_discontinuity(df: DataFrame, stream: str = "pid", order: str = "off", cc: str = "cc", modulus: int = 16) -> DataFrame:
    """Adds ``expected_cc`` (null for the first packet of a stream) and ``discontinuous``; the first packet never is."""
    before = F.lag(cc).over(Window.partitionBy(stream).orderBy(order))
    expected = F.pmod(before + 1, F.lit(modulus))
    return df.withColumn("expected_cc", expected).withColumn("discontinuous", F.coalesce(F.col(cc) != F.col("expected_cc"), F.lit(False)))


def repaired_cc(stream: str = "pid", order: str = "off", cc: str = "cc", modulus: int = 16) -> Column:
    """The counter renumbered without gaps from the first one of its stream."""
    w = Window.partitionBy(stream).orderBy(order)
    return F.pmod(F.first(cc).over(w) + F.row_number().over(w) - 1, F.lit(modulus))
