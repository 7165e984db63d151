"""Scans in blocks give the rows of windows over whole streams."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from riffle.operators import continuity, ordered, scans


@pytest.fixture(scope="module")
def long(spark):
    """A million packets of one stream, and two short ones beside it, one of them without a name."""
    rows = spark.range(1_000_000).select(F.lit("a").alias("pid"), F.col("id").alias("off"))
    more = spark.range(7).select(F.lit("b").alias("pid"), F.col("id").alias("off")).unionByName(spark.range(5).select(F.lit(None).cast("string").alias("pid"), F.col("id").alias("off")))
    rows = rows.unionByName(more)
    return rows.select("*", ((F.col("off") + F.xxhash64("off") % 50).cast("long") % 16).alias("cc"), (F.col("off") * 7 % 1_000).alias("seq"), F.when(F.col("off") % 3 == 0, F.col("off") % 4).alias("n")).repartition(6)


def same(got, want):
    columns = want.columns
    assert sorted(got.columns) == sorted(columns)
    a = got.select(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.count("*")).first()
    assert a == want.select(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.count("*")).first()


def windows(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return re.findall(r"\(\d+\) Window\n(?:Input.*\n)?Arguments: .*?\], \[(.*?)\]", text.getvalue())


def test_continuity(long):
    got = scans.with_discontinuity(long, blocks=8)
    same(got, continuity.with_discontinuity(long))
    same(scans.with_repaired_cc(long, blocks=8), long.withColumn("repaired_cc", continuity.repaired_cc()))


def test_extended_sequence(long):
    same(scans.extended_sequence(long, "seq", "pid", "off", 1_000, 8), ordered.extended_sequence(long, "seq", "pid", "off", 1_000))


def test_islands(long):
    inside = F.col("off") % 1_000 < 400
    same(scans.islands(long, inside, "pid", "off", 8), ordered.islands(long, inside, "pid", "off"))
    at = F.col("off") % 5 == 0
    want = ordered.islands(long.withColumn("now", ordered.carried(F.col("n"), at, "pid", "off")), F.col("now") == 1, "pid", "off")
    same(scans.carried_islands(long, F.col("n"), at, lambda now: now == 1, "pid", "off", 8), want)


def test_pts_range(long):
    rows = long.select("pid", "off", (F.col("off") * 40).alias("pts"))
    same(scans.pts_range(rows, 3_990, 30_000_001, "pid", "off", blocks=8), ordered.pts_range(rows, 3_990, 30_000_001, "pid", "off"))


def test_blocks_cut_a_stream_and_no_window_spans_it(long):
    rows = scans.blocked(long, "pid", "off", 8)
    sizes = [r["count"] for r in rows.groupBy(scans.BLOCK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 300_000
    found = scans.scan(rows, "pid", "off", s=scans.total(F.col("off")), p=scans.previous(F.col("cc")), q=scans.following(F.col("cc")), at=scans.number())
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        found.explain()
    lines = [x for x in text.getvalue().splitlines() if re.search(r"- Window ", x)]
    assert lines and all(scans.BLOCK in x for x in lines)
    # a window by stream alone stands over what is aggregated to a row for each block
    alone = [i for i, x in enumerate(lines) if not re.search(rf"\], \[pid#\d+, {scans.BLOCK}#\d+\]", x)]
    assert len(alone) == 1
    n = long.where("pid = 'a'").select("off", (F.col("off") * (F.col("off") + 1) / 2).cast("long").alias("s"), F.col("off").alias("at"))
    same(found.where("pid = 'a'").select("off", "s", "at"), n)
