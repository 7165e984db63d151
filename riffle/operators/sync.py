"""Synchronisation of two cameras: clock angles, pairing of frames, outliers and statistics."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.session import cut


def angle(dx: Column, dy: Column) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def offset_ms(left: Column, right: Column, period: float = 1000.0) -> Column:
    """The shorter way between two angles of one rotation, in milliseconds."""
    d = right - left
    short = F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    return short / 360.0 * period


#: Points of the sketches that narrow a selection, their accuracy, and distinct values of a group that are ranked exactly at the end.
GRID, ACCURACY, RANKED = 200, 10_000, 20_000


def quantiles(df: DataFrame, value: str, by: str, at: tuple[float, ...] = (0.25, 0.75), ranked: int = RANKED) -> DataFrame:
    """``by, q, quantile``: exact quantiles, with the two values beside a place between ranks mixed, as ``percentile`` has them.

    A selection in passes: mergeable sketches give bounds around the wanted rank of each group; what is below is counted exactly, and
    the values between go into the next pass, until a group has few different ones left. These are counted and ranked. No task holds
    the values of a group. Nulls do not count.
    """
    rows = cut(df.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(value).cast("double").alias("v")))
    sketch = F.percentile_approx("v", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), F.lit(ACCURACY)).alias("grid")
    ends = rows.groupBy("by").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), sketch)
    bounds = ends.withColumn("q", F.explode(F.array(*map(F.lit, at)))).withColumn("place", F.col("q") * (F.col("n") - 1))
    bounds = cut(bounds.select("by", "q", "place", F.floor("place").alias("k"), "n", "lo", "hi", "grid", F.lit(0).cast("long").alias("below"), F.col("n").alias("within"), F.lit(False).alias("done")))
    inside = F.col("v").between(F.col("low"), F.col("high"))
    while True:
        # a pass over the groups that have too much left: narrower bounds by the sketch, exact counts below and inside them
        at_grid = F.floor((F.col("k") - F.col("below")) / F.greatest(F.col("within") - 1, F.lit(1)) * GRID).cast("int")
        low = F.when(F.col("done"), F.col("lo")).otherwise(F.greatest("lo", F.get("grid", F.greatest(at_grid - 2, F.lit(0)))))
        high = F.when(F.col("done"), F.col("hi")).otherwise(F.least("hi", F.get("grid", F.least(at_grid + 3, F.lit(GRID)))))
        tried = bounds.select("by", "q", "place", "k", "n", "lo", "hi", "done", low.alias("low"), high.alias("high"))
        joined = rows.withColumnRenamed("by", "own").join(tried, F.col("own").eqNullSafe(F.col("by"))).drop("own")
        counted = joined.groupBy("by", "q", "place", "k", "n", "lo", "hi", "done", "low", "high").agg(
            F.sum((F.col("v") < F.col("low")).cast("long")).alias("below"),
            F.sum(inside.cast("long")).alias("within"),
            F.approx_count_distinct(F.when(inside, F.col("v"))).alias("different"),
            F.percentile_approx(F.when(inside, F.col("v")), F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), F.lit(ACCURACY)).alias("grid"),
        )
        # bounds that missed the rank go back to the ones before and stay; so do those that leave few values or do not move
        good = (F.col("below") <= F.col("k")) & (F.col("below") + F.col("within") >= F.least(F.col("k") + 2, F.col("n")))
        still = (F.col("low") == F.col("lo")) & (F.col("high") == F.col("hi"))
        counted = counted.withColumn("missed", ~good).withColumn("done", ~good | still | (F.col("different") <= ranked))
        back = lambda new, old: F.when(F.col("missed"), F.col(old)).otherwise(F.col(new))
        bounds = cut(counted.select("by", "q", "place", "k", "n", back("low", "lo").alias("lo"), back("high", "hi").alias("hi"), "grid", "below", "within", "done", "missed"))
        left = bounds.agg(F.sum((~F.col("done")).cast("long")), F.sum(F.col("missed").cast("long"))).first()
        if not left[0]:
            if not left[1]:
                break
            bounds = bounds.drop("missed")  # one more pass counts what is below the bounds that were restored
    counted = bounds.select("by", "q", "place", "k", "below", F.col("lo").alias("low"), F.col("hi").alias("high"))
    middle = rows.withColumnRenamed("by", "own").join(counted, F.col("own").eqNullSafe(F.col("by"))).where(inside)
    middle = middle.groupBy("by", "q", "place", "k", "below", "v").count()
    up_to = F.col("below") + F.sum("count").over(Window.partitionBy("by", "q").orderBy("v"))
    two = middle.withColumn("up_to", up_to).groupBy("by", "q", "place", "k").agg(F.min(F.when(F.col("up_to") > F.col("k"), F.col("v"))).alias("a"), F.min(F.when(F.col("up_to") > F.col("k") + 1, F.col("v"))).alias("b"))
    mixed = (F.col("k") + 1 - F.col("place")) * F.col("a") + (F.col("place") - F.col("k")) * F.col("b")
    return two.select(F.col("by").alias(by), "q", F.when((F.col("place") == F.col("k")) | (F.col("a") == F.col("b")), F.col("a")).otherwise(mixed).alias("quantile"))


def quartile_bounds(df: DataFrame, value: str, by: str) -> DataFrame:
    q = quantiles(df, value, by)
    of = q.groupBy(by).agg(F.max(F.when(F.col("q") == 0.25, F.col("quantile"))).alias("q1"), F.max(F.when(F.col("q") == 0.75, F.col("quantile"))).alias("q3"))
    return of.select(by, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"))


def correction_log(df: DataFrame, stream: str, order: str, ready: Column, duration: str, timer: str) -> DataFrame:
    """``stream, order, event, value, last_ten``: the timer of the first frame that is ready (INITIAL_DIFF), and for each later one whose duration is off a CORRECTION.

    The duration to hold is the last one that was no correction, which is the first that was not zero. ``last_ten`` has the
    corrections up to each, ten at most.
    """
    w = Window.partitionBy(stream).orderBy(order)
    held = F.first(F.when(F.col(duration) != 0, F.col(duration)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.where(ready).select(stream, order, F.col(timer).cast("double").alias("timer"), (held - F.col(duration)).alias("off_by"), F.row_number().over(w).alias("n"))
    begun = rows.where("n = 1").select(stream, order, F.lit("INITIAL_DIFF").alias("event"), F.col("timer").alias("value"), F.array().cast("array<double>").alias("last_ten"))
    off = rows.where("off_by <> 0").select(stream, order, F.col("off_by").cast("double").alias("value"))
    off = off.withColumn("last_ten", F.collect_list("value").over(w.rowsBetween(-9, 0)))
    return begun.unionByName(off.select(stream, order, F.lit("CORRECTION").alias("event"), "value", "last_ten"))


def without_outliers(df: DataFrame, value: str, by: str) -> DataFrame:
    """Rows within one and a half interquartile ranges of the quartiles, bounds included."""
    return df.join(quartile_bounds(df, value, by), by).where(F.col(value).between(F.col("low"), F.col("high"))).drop("low", "high")


def statistics(df: DataFrame, value: str, by: str) -> DataFrame:
    """All pairs and those that are no outliers: counts, mean and population deviation; 0 where there are none."""
    total = df.groupBy(by).agg(F.count("*").alias("frames"))
    kept = without_outliers(df, value, by).groupBy(by).agg(F.count("*").alias("filtered"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return total.join(kept, by, "left").select(by, "frames", F.coalesce("filtered", F.lit(0)).alias("filtered"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"))


def greedy_pairs(left: DataFrame, right: DataFrame, by: str, tolerance_ms: float = 10.0) -> DataFrame:
    """Frames (``by, ms, frame``) paired in order: the stream that lags goes on until both are within the tolerance, then both do.

    Each frame is used once at most, so this is a merge and not an interval join. Frames of both sides pass through a task in
    the order of time, and only those are held that a frame still to come may be within the tolerance of.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = object(), (deque(), deque())
        for batch in batches:
            out: list[tuple] = []
            for key, ms, side, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, held = key, (deque(), deque())
                held[side].append((ms, frame))
                while held[0] and held[1]:
                    a, b = held[0][0], held[1][0]
                    if abs(a[0] - b[0]) <= tolerance_ms:
                        out.append((key, a[1], b[1], b[0] - a[0]))
                        held[0].popleft()
                        held[1].popleft()
                    else:
                        held[0 if a[0] < b[0] else 1].popleft()
                for q in held:
                    while q and q[0][0] < ms - tolerance_ms:
                        q.popleft()
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[by, "left_frame", "right_frame", "gap_ms"])

    kind = dict(left.dtypes)[by]
    side = lambda df, n: df.select(by, F.col("ms").cast("double").alias("ms"), F.lit(n).alias("side"), F.col("frame").cast("long").alias("frame"))
    rows = side(left, 0).unionByName(side(right, 1)).repartition(by).sortWithinPartitions(by, "ms", "side", "frame")
    return rows.mapInArrow(merge, f"{by} {kind}, left_frame long, right_frame long, gap_ms double")


def file_pairs(names: DataFrame, name: str = "name") -> DataFrame:
    """``left_<time>.mkv`` and ``right_<time>.mkv`` of one time; files without a partner are left out."""
    side = lambda s: names.select(F.regexp_extract(name, rf"^{s}_(\d{{8}}_\d{{6}})\.mkv$", 1).alias("time"), F.col(name).alias(s)).where("time <> ''")
    return side("left").join(side("right"), "time")


def corners(points: DataFrame, by: str) -> DataFrame:
    """Of four points the corners top left, top right, bottom right and bottom left: least and largest sum and difference."""
    s, d = F.col("x") + F.col("y"), F.col("y") - F.col("x")
    p = F.struct("x", "y")
    return points.groupBy(by).agg(F.min_by(p, s).alias("tl"), F.min_by(p, d).alias("tr"), F.max_by(p, s).alias("br"), F.max_by(p, d).alias("bl"))


def largest(df: DataFrame, by: str, area: str, least: float, place: tuple[str, ...] = ()) -> DataFrame:
    """The row of the largest area of each group, if that is above ``least``; of equal areas the first by the columns of ``place``, which are left out."""
    row = F.struct(*[c for c in df.columns if c not in place])
    first = F.struct(~F.isnan(area), -F.col(area), *place)  # not a number is above all numbers
    best = df.where(F.col(area) > least).groupBy(by).agg(F.min_by(row, first).alias("r"))
    return best.select("r.*")
