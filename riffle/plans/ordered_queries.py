"""Segments, ranges and clocks over the packet view and over the turns of conversations (frames with a changing attribute)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.operators import ordered as o
from riffle.plans.views import PACKETS_SQL, packets, raw_packets
from riffle.session import table

# In the packet view a ``view`` event stands for a PMT; its metadata is k % 4, and none where k ends in 0.
META_SQL = f"""{PACKETS_SQL}, meta AS (
  SELECT *, event_type = 'view' AS pmt, CASE WHEN event_type = 'view' AND k % 10 <> 0 THEN k % 4 END AS n FROM packets)"""


def with_meta(df: DataFrame) -> DataFrame:
    pmt = F.col("event_type") == "view"
    return df.withColumn("pmt", pmt).withColumn("n", F.when(pmt & (F.col("k") % 10 != 0), F.col("k") % 4))


def segments_for_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_meta(raw_packets(spark, sf_dir)).withColumn("now", o.carried(F.col("n"), F.col("pmt"), "pid", "off"))
    return o.islands(rows, F.col("now") == 1, "pid", "off")


def trim_to_meta_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_meta(raw_packets(spark, sf_dir))
    found = o.range_between(rows, F.col("pmt") & (F.col("n") == 1), F.col("pmt") & (F.col("n") == 3), "pid", "off")
    inside = rows.join(found, "pid").where(F.col("off").between(F.col("first_off"), F.col("last_off")))
    counts = inside.groupBy("pid").agg(F.count("*").alias("n_packets"))
    return found.join(counts, "pid", "left").select("pid", "first_off", "last_off", "err", F.coalesce("n_packets", F.lit(0)).alias("n_packets"))


def frame_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.islands(table(spark, sf_dir, "conversations"), F.col("role") == "assistant", "conv_id", "turn")


def frame_meta_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return o.range_between(rows, F.col("role") == "user", F.col("role") == "assistant", "conv_id", "turn")


def pts_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir).where("pusi")
    return o.first_and_last(rows.select("pid", "off", "pts"), "pts", "pid", "off").select("pid", F.col("first").alias("first_pts"), F.col("last").alias("last_pts"))


def trim_to_pts_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_packets(spark, sf_dir).select("pid", F.col("ts_us"), "off", F.expr("(ts_us * 9) div 100").alias("pts"))
    low, high = (F.expr(f"(unix_micros(timestamp '2024-01-{d} 00:00:00') * 9) div 100") for d in ("10", "12"))
    return o.pts_range(rows.select("pid", "off", "pts").withColumn("seq", F.row_number().over(Window.partitionBy("pid").orderBy("pts", "off"))), low, high, "pid", "seq").select("pid", "off", "pts")


def first_last_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_packets(spark, sf_dir)
    return rows.groupBy("pid").agg(F.min("off").alias("first_off"), F.min_by("k", "off").alias("first_k"), F.max("off").alias("last_off"), F.max_by("k", "off").alias("last_k"))


def find_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first PAT (``signup``) of each PID whose next packet is a PMT (``view``), with the metadata that it carries."""
    rows = with_meta(raw_packets(spark, sf_dir)).select("pid", "off", "event_type", "pmt", "n")
    w = o.window("pid", "off")
    rows = rows.withColumn("next_pmt", F.lead("pmt").over(w)).withColumn("next_n", F.lead("n").over(w)).where("event_type = 'signup'")
    first = rows.groupBy("pid").agg(F.min(F.when(F.col("next_pmt"), F.struct("off", F.col("next_n").alias("n")))).alias("hit"), F.min("off").alias("pat_off"))
    return first.select("pid", "pat_off", F.col("hit.off").alias("psi_off"), F.col("hit.n").alias("meta_n"), F.when(F.col("hit").isNull(), "PMT does not follow PAT").alias("err"))


def rtp_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_packets(spark, sf_dir).select("pid", "off", F.expr("(off * 37) % 65536").alias("seq"))
    last = o.extended_sequence(rows, "seq", "pid", "off")
    return last.groupBy("pid").agg(F.max("cycles").alias("cycles"), F.max_by("seq", "off").alias("last_seq"), F.max_by("extended_seq", "off").alias("extended_seq"), F.count("*").alias("n"))


def ts_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PTS, PCR and counter of the n-th frame at 25 frames a second; the presentation clock starts 0.7 s late and wraps at 33 bits."""
    rows = raw_packets(spark, sf_dir).select("pid", "off", (F.row_number().over(o.window("pid", "off")) - 1).alias("n"))
    return rows.select("pid", "off", F.expr("(n * 3600 + 63000) % 8589934592").alias("pts"), F.expr("n * 3600").alias("pcr"), (F.col("n") % 16).alias("cc"))


def rtp_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_packets(spark, sf_dir).select("pid", "off", (F.row_number().over(o.window("pid", "off")) - 1).alias("n"))
    return rows.select("pid", "off", ((F.col("n") + 65_500) % 65_536).alias("seq"), F.expr("(cast(n as bigint) * 3600) % 4294967296").alias("rtp_ts"))


def flv_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_packets(spark, sf_dir).select("pid", "off", F.expr("ts_us div 1000").alias("ms"))
    return rows.select("pid", "off", (F.col("ms") - F.first("ms").over(o.window("pid", "off"))).alias("flv_ms"))


def duration_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame durations that differ from the one before, and the last ten changes up to each."""
    rows = raw_packets(spark, sf_dir).select("pid", "off", F.col("k").alias("duration"))
    w = o.window("pid", "off")
    rows = rows.withColumn("before", F.lag("duration").over(w)).where("duration <> before")
    last = F.sum("duration").over(w.rowsBetween(-9, 0))
    return rows.select("pid", "off", "before", "duration", last.alias("sum_last_10"))


def receiver_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each packet: the middle 32 bits of the NTP time of the latest sender report (``purchase``) and the delay since it in 1/65536 s."""
    rows = raw_packets(spark, sf_dir)
    sent = o.carried(F.col("ts_us"), F.col("event_type") == "purchase", "pid", "off")
    rows = rows.withColumn("sent", sent).where("sent IS NOT NULL")
    seconds, micros = F.expr("sent div 1000000 + 2208988800"), F.expr("sent % 1000000")
    middle = (seconds % 65_536) * 65_536 + F.floor(micros * 65_536 / 1_000_000)
    return rows.select("pid", "off", middle.cast("long").alias("last_sr"), F.expr("((ts_us - sent) * 65536) div 1000000").alias("delay"))


QUERIES = {f.__name__: f for f in (segments_for_meta, trim_to_meta_range, frame_segments, frame_meta_range, pts_range, trim_to_pts_range, first_last_packet, find_psi, rtp_cycles, ts_clocks, rtp_clocks, flv_timestamps, duration_changes, receiver_reports)}

_ISLANDS = """flags AS (SELECT {s}, {o}, inside, inside AND NOT coalesce(lag(inside) OVER (PARTITION BY {s} ORDER BY {o}), false) AS start FROM src),
runs AS (SELECT *, CAST(sum(CASE WHEN start THEN 1 ELSE 0 END) OVER (PARTITION BY {s} ORDER BY {o}) AS BIGINT) AS segment FROM flags)
SELECT {s}, segment, min({o}) AS first_off, max({o}) AS last_off, count(*) AS n FROM runs WHERE inside GROUP BY {s}, segment"""
_RANGE = """firsts AS (SELECT {s}, min(CASE WHEN {a} THEN {o} END) AS first_off FROM src GROUP BY {s}),
found AS (SELECT f.{s}, f.first_off, (SELECT min(x.{o}) FROM src x WHERE x.{s} = f.{s} AND {b} AND x.{o} > f.first_off) AS last_off FROM firsts f)"""
_ERR = "CASE WHEN first_off IS NULL THEN 'start not found' WHEN last_off IS NULL THEN 'end not found' END AS err"

ORACLES = {
    "segments_for_meta": f"""WITH {META_SQL}, eras AS (SELECT *, sum(CASE WHEN pmt THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY off) AS era FROM meta),
src AS (SELECT pid, off, coalesce(max(n) OVER (PARTITION BY pid, era) = 1, false) AS inside FROM eras), {_ISLANDS.format(s="pid", o="off")}""",
    "trim_to_meta_range": f"""WITH {META_SQL}, src AS (SELECT pid, off, pmt AND n = 1 AS a, pmt AND n = 3 AS b FROM meta), {_RANGE.format(s="pid", o="off", a="a", b="x.b")}
SELECT pid, first_off, last_off, {_ERR}, (SELECT count(*) FROM src x WHERE x.pid = f.pid AND x.off BETWEEN f.first_off AND f.last_off) AS n_packets FROM found f""",
    "frame_segments": f"WITH src AS (SELECT conv_id, turn, role = 'assistant' AS inside FROM conversations), {_ISLANDS.format(s='conv_id', o='turn')}",
    "pts_range": f"WITH {PACKETS_SQL} SELECT pid, arg_min(pts, off) AS first_pts, arg_max(pts, off) AS last_pts FROM packets WHERE pusi GROUP BY pid",
    "trim_to_pts_range": f"""WITH {PACKETS_SQL}, nexts AS (SELECT pid, off, pts, lead(pts) OVER (PARTITION BY pid ORDER BY pts, off) AS after FROM packets)
SELECT pid, off, pts FROM nexts WHERE after > (epoch_us(TIMESTAMP '2024-01-10 00:00:00') * 9) // 100 AND pts < (epoch_us(TIMESTAMP '2024-01-12 00:00:00') * 9) // 100""",
    "first_last_packet": f"WITH {PACKETS_SQL} SELECT pid, min(off) AS first_off, arg_min(k, off) AS first_k, max(off) AS last_off, arg_max(k, off) AS last_k FROM packets GROUP BY pid",
    "find_psi": f"""WITH {META_SQL}, nexts AS (SELECT pid, off, event_type, lead(pmt) OVER w AS next_pmt, lead(n) OVER w AS next_n FROM meta WINDOW w AS (PARTITION BY pid ORDER BY off))
SELECT pid, min(off) AS pat_off, min(CASE WHEN next_pmt THEN off END) AS psi_off, arg_min(CASE WHEN next_n IS NULL THEN -1 ELSE next_n END, off) FILTER (next_pmt) AS meta_n0,
  CASE WHEN min(CASE WHEN next_pmt THEN off END) IS NULL THEN 'PMT does not follow PAT' END AS err FROM nexts WHERE event_type = 'signup' GROUP BY pid""",
    "rtp_cycles": f"""WITH {PACKETS_SQL}, s AS (SELECT pid, off, (off * 37) % 65536 AS seq FROM packets), l AS (SELECT *, lag(seq) OVER (PARTITION BY pid ORDER BY off) AS before FROM s),
c AS (SELECT *, CAST(sum(CASE WHEN seq < before THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY off) AS BIGINT) AS cycles FROM l)
SELECT pid, max(cycles) AS cycles, arg_max(seq, off) AS last_seq, arg_max(cycles * 65536 + seq, off) AS extended_seq, count(*) AS n FROM c GROUP BY pid""",
    "ts_clocks": f"""WITH {PACKETS_SQL}, r AS (SELECT pid, off, row_number() OVER (PARTITION BY pid ORDER BY off) - 1 AS n FROM packets)
SELECT pid, off, CAST(floor((n / 25.0 + 0.7) * 90000 + 1e-6) AS BIGINT) % 8589934592 AS pts, CAST(floor(n / 25.0 * 90000 + 1e-6) AS BIGINT) AS pcr, n % 16 AS cc FROM r""",
    "rtp_clocks": f"""WITH {PACKETS_SQL}, r AS (SELECT pid, off, row_number() OVER (PARTITION BY pid ORDER BY off) - 1 AS n FROM packets)
SELECT pid, off, (n + 65500) % 65536 AS seq, (n * 3600) % 4294967296 AS rtp_ts FROM r""",
    "flv_timestamps": f"WITH {PACKETS_SQL} SELECT pid, off, ts_us // 1000 - first_value(ts_us // 1000) OVER (PARTITION BY pid ORDER BY off) AS flv_ms FROM packets",
    "duration_changes": f"""WITH {PACKETS_SQL}, l AS (SELECT pid, off, k AS duration, lag(k) OVER (PARTITION BY pid ORDER BY off) AS before FROM packets), c AS (SELECT * FROM l WHERE duration <> before)
SELECT pid, off, before, duration, CAST(sum(duration) OVER (PARTITION BY pid ORDER BY off ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS sum_last_10 FROM c""",
    "receiver_reports": f"""WITH {PACKETS_SQL}, s AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN off END) OVER (PARTITION BY pid ORDER BY off) AS sr FROM packets),
j AS (SELECT s.pid, s.off, s.ts_us, p.ts_us AS sent FROM s JOIN packets p ON p.pid = s.pid AND p.off = s.sr)
SELECT pid, off, ((sent // 1000000 + 2208988800) % 65536) * 65536 + CAST(floor((sent % 1000000) * 65536 / 1000000) AS BIGINT) AS last_sr, ((ts_us - sent) * 65536) // 1000000 AS delay FROM j""",
}
ORACLES["find_psi"] = f"SELECT pid, pat_off, psi_off, CASE WHEN meta_n0 >= 0 THEN meta_n0 END AS meta_n, err FROM ({ORACLES['find_psi']})"
ORACLES["frame_meta_range"] = f"WITH src AS (SELECT * FROM conversations), {_RANGE.format(s='conv_id', o='turn', a='''role = 'user' ''', b='''x.role = 'assistant' ''')} SELECT conv_id, first_off, last_off, {_ERR} FROM found"
