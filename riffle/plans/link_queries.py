"""Events of camera links and the sends of RTMP messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import packing as pk
from riffle.operators import sync, transport
from riffle.operators.ordered import window
from riffle.plans.transport_queries import frames
from riffle.plans.views import raw_packets


def correction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each camera: those that failed (``error``) are not ready, the duration is k."""
    rows = raw_packets(spark, sf_dir)
    found = sync.correction_log(rows, "pid", "off", F.col("event_type") != "error", "k", "value")
    return found.select("pid", "off", "event", "value", F.array_join(F.transform("last_ten", lambda v: v.cast("long").cast("string")), " ").alias("last_ten"))


def rtmp_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn of a conversation says as a message on the conversation's channel, of up to three bytes, and in how many sends it goes out."""
    w = window("conv_id", "turn")
    channel = 2 + F.col("conv_id") * 131 % 65_598
    rows = frames(spark, sf_dir).select("conv_id", "turn", "data", F.octet_length("data").alias("size"), (F.floor(F.col("turn") / 2) * 40).cast("long").alias("ms"), F.when(F.col("role") == "user", 8).otherwise(9).alias("packet_type"), channel.alias("channel"))
    rows = rows.withColumn("delta", F.col("ms") - F.lag("ms").over(w))
    alike = F.coalesce((F.lag("size").over(w) == F.col("size")) & (F.lag("packet_type").over(w) == F.col("packet_type")), F.lit(False))
    rows = rows.withColumn("kind", pk.rtmp_header_size(F.col("delta").isNotNull(), alike, F.col("delta") == 0))
    rows = rows.withColumn("head", F.col("kind") + F.when(F.col("channel") > 319, 2).when(F.col("channel") > 63, 1).otherwise(0))
    rows = transport.rtmp_sends(rows, "conv_id", "turn")
    out = transport.rtmp_chunks(F.col("kind"), F.lit(1), F.col("channel"), F.col("ms"), F.coalesce("delta", F.lit(0)), F.col("size"), F.col("packet_type"), F.col("data"))
    return rows.select("conv_id", "turn", F.col("kind").cast("int").alias("kind"), "deferred", "joined", "sends", F.sha2(out, 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (correction_log, rtmp_sends)}

_CHANNEL = "CASE WHEN ch > 319 THEN printf('%02X%02X%02X', {t} + 1, (ch - 64) % 256, (ch - 64) // 256) WHEN ch > 63 THEN printf('%02X%02X', {t}, ch - 64) ELSE printf('%02X', {t} + ch) END"
ORACLES = {
    "correction_log": """WITH r AS (SELECT user_id % 8000 AS pid, event_id AS off, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events WHERE event_type <> 'error'),
b AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY off) AS i, (SELECT min(x.off) FROM r x WHERE x.pid = r.pid AND x.k <> 0) AS base_off FROM r),
c AS (SELECT b.*, CASE WHEN b.off >= b.base_off THEN x.k - b.k END AS d FROM b LEFT JOIN r x ON x.off = b.base_off AND x.pid = b.pid),
n AS (SELECT pid, off, d, list(d) OVER (PARTITION BY pid ORDER BY off ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ten FROM c WHERE d <> 0)
SELECT pid, off, 'INITIAL_DIFF' AS event, CAST(value AS DOUBLE) AS value, '' AS last_ten FROM c WHERE i = 1 UNION ALL SELECT pid, off, 'CORRECTION', CAST(d AS DOUBLE), array_to_string(ten, ' ') FROM n""",
    "rtmp_sends": f"""WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 8 ELSE 9 END AS ty, strlen(coalesce(text, '')) AS size, hex(encode(coalesce(text, ''))) AS h, CAST(turn // 2 * 40 AS BIGINT) AS ms, 2 + conv_id * 131 % 65598 AS ch FROM conversations),
d AS (SELECT *, row_number() OVER w AS i, ms - lag(ms) OVER w AS delta, lag(size) OVER w = size AND lag(ty) OVER w = ty AS alike, ty = 8 AND size < 128 AS small, coalesce(lag(ty = 8 AND size < 128) OVER w, false) AS small_before FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, CASE WHEN delta IS NULL THEN 12 WHEN NOT coalesce(alike, false) THEN 8 WHEN delta <> 0 THEN 4 ELSE 1 END AS kind, max(CASE WHEN NOT small OR NOT small_before THEN i END) OVER (PARTITION BY conv_id ORDER BY turn) AS start FROM d),
g AS (SELECT *, small AND (i - start) % 2 = 0 AS deferred, kind + CASE WHEN ch > 319 THEN 2 WHEN ch > 63 THEN 1 ELSE 0 END AS head, array_to_string(list_transform(range(0, (size + 127) // 128), lambda k: CASE WHEN k > 0 THEN {_CHANNEL.format(t=192)} ELSE '' END || substring(h, k * 256 + 1, 256)), '') AS body FROM e),
s AS (SELECT *, coalesce(lag(deferred) OVER w, false) AS waits, lag(size + head) OVER w AS held FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(kind AS INTEGER) AS kind, deferred, waits AND held + size + head <= 128 AS joined, CAST(CASE WHEN deferred THEN 0 ELSE greatest(1, (size + 127) // 128) + CASE WHEN waits AND NOT held + size + head <= 128 THEN 1 ELSE 0 END END AS INTEGER) AS sends,
 sha256(unhex(CASE kind WHEN 12 THEN {_CHANNEL.format(t=0)} || printf('%06X', ms) WHEN 8 THEN {_CHANNEL.format(t=64)} || printf('%06X', delta) WHEN 4 THEN {_CHANNEL.format(t=128)} || printf('%06X', delta) ELSE {_CHANNEL.format(t=192)} END
  || CASE WHEN kind > 4 THEN printf('%06X', size) || printf('%02X', ty) ELSE '' END || CASE WHEN kind > 8 THEN '01000000' ELSE '' END || coalesce(body, ''))) AS sha256 FROM s""",
}
