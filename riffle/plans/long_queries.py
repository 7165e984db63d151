"""Windows longer than a task: all events as packets of one stream, scanned in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.operators import scans
from riffle.session import table

STREAM_SQL = """src AS (SELECT 0::BIGINT AS stream, event_id AS off, epoch_us(ts) AS ts_us, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def one_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("stream"), F.col("event_id").alias("off"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_type", k.alias("k"))


def long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the metadata that PMTs (``view``) name: runs of packets under number 1."""
    n = F.when(F.col("k") % 10 != 0, F.col("k") % 4)
    return scans.carried_islands(one_stream(spark, sf_dir), n, F.col("event_type") == "view", lambda now: now == 1, "stream", "off")


def long_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_stream(spark, sf_dir).select("stream", "off", ((F.col("off") + (F.col("event_type") == "error").cast("long")) % 16).alias("cc"))
    return scans.with_discontinuity(rows, "stream").select("off", "cc", "expected_cc", "discontinuous")


def long_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_stream(spark, sf_dir).select("stream", "off", (F.col("k") % 16).alias("cc"))
    return scans.with_repaired_cc(rows, "stream").select("off", "cc", "repaired_cc")


def long_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_stream(spark, sf_dir).select("stream", "off", ((F.col("off") * 37) % 4_096).alias("seq"))
    return scans.extended_sequence(rows, "seq", "stream", "off", 4_096).select("off", "seq", "cycles", "extended_seq")


def long_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentation clock of the n-th frame, the delay since the latest sender report (``purchase``), and milliseconds since the first packet."""
    running = {"n": scans.number(), "sent": scans.latest(F.col("ts_us"), F.col("event_type") == "purchase"), "begin": scans.first(F.col("ts_us"))}
    rows = scans.scan(scans.blocked(one_stream(spark, sf_dir), "stream", "off"), "stream", "off", **running)
    return rows.select("off", ((F.col("n") * 3_600 + 63_000) % 8_589_934_592).alias("pts"), F.expr("((ts_us - sent) * 65536) div 1000000").alias("delay"), F.expr("ts_us div 1000 - begin div 1000").alias("ms"))


def long_pts_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = one_stream(spark, sf_dir).select("stream", "off", (F.col("off") * 3_600).alias("pts"))
    return scans.pts_range(rows, 360_000, 3_600_000, "stream", "off").select("off", "pts")


QUERIES = {f.__name__: f for f in (long_segments, long_continuity, long_repair, long_cycles, long_clocks, long_pts_range)}

ORACLES = {
    "long_segments": f"""WITH {STREAM_SQL}, eras AS (SELECT *, CASE WHEN event_type = 'view' AND k % 10 <> 0 THEN k % 4 END AS n, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (ORDER BY off) AS era FROM src),
i AS (SELECT off, coalesce(max(n) OVER (PARTITION BY era) = 1, false) AS inside FROM eras), s AS (SELECT *, inside AND NOT coalesce(lag(inside) OVER (ORDER BY off), false) AS start FROM i),
r AS (SELECT *, CAST(sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (ORDER BY off) AS BIGINT) AS segment FROM s)
SELECT 0::BIGINT AS stream, segment, min(off) AS first_off, max(off) AS last_off, count(*) AS n FROM r WHERE inside GROUP BY segment""",
    "long_continuity": f"""WITH {STREAM_SQL}, c AS (SELECT off, (off + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) % 16 AS cc FROM src), e AS (SELECT *, (lag(cc) OVER (ORDER BY off) + 1) % 16 AS expected_cc FROM c)
SELECT off, cc, expected_cc, coalesce(cc <> expected_cc, false) AS discontinuous FROM e""",
    "long_repair": f"WITH {STREAM_SQL} SELECT off, k % 16 AS cc, (first_value(k % 16) OVER (ORDER BY off) + row_number() OVER (ORDER BY off) - 1) % 16 AS repaired_cc FROM src",
    "long_cycles": f"""WITH {STREAM_SQL}, s AS (SELECT off, (off * 37) % 4096 AS seq FROM src), l AS (SELECT *, lag(seq) OVER (ORDER BY off) AS was FROM s), c AS (SELECT off, seq, CAST(sum(CASE WHEN seq < was THEN 1 ELSE 0 END) OVER (ORDER BY off) AS BIGINT) AS cycles FROM l)
SELECT off, seq, cycles, cycles * 4096 + seq AS extended_seq FROM c""",
    "long_clocks": f"""WITH {STREAM_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY off) - 1 AS n, first_value(ts_us) OVER (ORDER BY off) AS begin, max(CASE WHEN event_type = 'purchase' THEN off END) OVER (ORDER BY off) AS sr FROM src)
SELECT n.off, (n * 3600 + 63000) % 8589934592 AS pts, ((n.ts_us - p.ts_us) * 65536) // 1000000 AS delay, n.ts_us // 1000 - begin // 1000 AS ms FROM n LEFT JOIN src p ON p.off = n.sr""",
    "long_pts_range": f"""WITH {STREAM_SQL}, l AS (SELECT off, off * 3600 AS pts, lead(off * 3600) OVER (ORDER BY off) AS after FROM src) SELECT off, pts FROM l WHERE after > 360000 AND pts < 3600000""",
}
