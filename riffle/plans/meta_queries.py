"""Metadata, PSI, URL, RTSP, code-table and camera queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import meta as m
from riffle.functions import packing as pk
from riffle.functions import parsing as ps
from riffle.functions.bytesx import be
from riffle.operators import sync
from riffle.session import table


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k, v: F.struct(F.lit(k).alias("k"), F.col(v).cast("string").alias("v"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array(e("cust", "o_custkey"), e("status", "o_orderstatus"), e("prio", "o_orderpriority")).alias("kv"))


def meta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("o_orderkey", F.hex(m.encoded(F.col("kv"))).alias("meta"))


def meta_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = m.upserted(m.upserted(F.col("kv"), F.lit("status"), F.lit("X")), F.lit("ts"), F.col("o_orderkey").cast("string"))
    return entries(spark, sf_dir).select("o_orderkey", m.encoded_text(m.deleted(kv, F.lit("cust"))).alias("meta"))


def meta_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh record is damaged in one of three ways."""
    whole = m.encoded(F.col("kv"))
    k = F.col("o_orderkey") % 21
    damaged = F.when(k == 0, F.substring(whole, F.lit(1), F.lit(3))).when(k == 7, F.substring(whole, F.lit(1), F.lit(9))).when(k == 14, m.encoded(F.array(F.struct(F.lit("a=b").alias("k"), F.lit("c").alias("v"))))).otherwise(whole)
    rows = entries(spark, sf_dir).select("o_orderkey", damaged.alias("data"))
    found, err = m.decoded(F.col("data"))
    rows = rows.select("o_orderkey", found.alias("kv"), err.alias("err"))
    return rows.select("o_orderkey", "err", F.get(F.filter("kv", lambda e: e["k"] == "prio"), F.lit(0))["v"].alias("prio"), F.size("kv").alias("n"))


def psi_with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PMT with the metadata as descriptor 26 behind another one, read back: tags, metadata, and the CRC checked over the section."""
    both = F.concat(pk.descriptor(5, F.encode(F.lit("RIFF"), "UTF-8")), pk.descriptor(0x26, m.encoded(F.col("kv"))))
    rows = entries(spark, sf_dir).select("o_orderkey", pk.pmt(F.col("o_orderkey") % 1000 + 1, 256, both, 27).alias("pmt"))
    rows = rows.select("o_orderkey", "pmt", ps.descriptors(F.col("pmt")).alias("d"))
    rows = rows.withColumn("data", F.get(F.filter("d", lambda x: x["tag"] == 0x26), F.lit(0))["data"])
    found, err = m.decoded(F.col("data"))
    return rows.select("o_orderkey", be(F.col("pmt"), 3, 2).alias("program"), F.array_join(F.transform("d", lambda x: x["tag"].cast("string")), ",").alias("tags"), m.encoded_text(found).alias("meta"), err.alias("err"), F.octet_length("pmt").alias("size"))


def psi_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata replaced or added in a PMT: whole sections in hex after the edit, streams read from them, and the PAT that names them."""
    first = F.when(F.col("o_orderkey") % 2 == 0, pk.descriptor(0x26, F.encode(F.lit("old"), "UTF-8"))).otherwise(F.lit(b""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", pk.pmt(F.col("o_orderkey") % 1000 + 1, 256, first, 27).alias("pmt"), pk.pat(F.col("o_orderkey") % 500, 1, 4096).alias("pat"))
    rows = rows.select("o_orderkey", ps.with_descriptor(F.col("pmt"), 0x26, F.encode("o_orderstatus", "UTF-8")).alias("pmt"), ps.programs(F.col("pat")).alias("p"))
    s = ps.elementary_streams(F.col("pmt"))
    return rows.select("o_orderkey", F.hex(F.expr("substring(pmt, 1, octet_length(pmt) - 4)")).alias("section"), F.col("p")[1].alias("pmt_pid"), F.size("p").alias("n_programs"), F.to_json(s).alias("streams"))


def url_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as stream addresses: the scheme, the extension and the query vary with the id."""
    k = F.col("page_id") % 7
    scheme = F.element_at(F.array(*map(F.lit, ("rtmp", "rtmpt", "rtmps", "rtmpe", "http", "rtmp", "rtmpts"))), (k + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, ("/a.mp4", "/b.flv", "/c", "/mp3:d.mp3", "/e.f4v", "", "/f.mp3?key=1"))), (F.col("page_id") % 5 + 1 + F.when(k == 5, 2).otherwise(0)).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), tail).alias("rest"), scheme.alias("scheme")).select("page_id", F.concat("scheme", F.lit("://"), "rest").alias("url"))
    return rows.select("page_id", "url", *[c.alias(n) for n, c in m.url_fields(F.col("url")).items()])


def rtsp_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    rows = table(spark, sf_dir, "pages").select("page_id", m.rtsp_request("SETUP", F.col("page_id") + 1, F.col("url"), F.array(head("Transport", F.lit("RTP/AVP;unicast")), head("Session", F.col("page_id").cast("string")))).alias("request"))
    reply = F.concat(F.lit("RTSP/1.0 "), F.when(F.col("page_id") % 3 == 0, "404 Not Found").otherwise("200 OK"), F.lit("\r\nCSeq: "), (F.col("page_id") + 1).cast("string"), F.lit("\r\nPublic: PLAY\r\nPublic: SETUP\r\n\r\n"))
    r = m.rtsp_response(reply)
    return rows.select("page_id", "request", r["status"].alias("status"), r["reason"].alias("reason"), F.array_join(r["headers"]["Public"], "|").alias("public"), r["headers"]["CSeq"][0].alias("cseq"))


def codec_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media type, PID and stream id by a broadcast of the fixed code table; unknown ids stay, with an error."""
    codecs = spark.createDataFrame(m.CODECS, "codec string, mime string, pid int, stream_id int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, (27, 36, 136, 192, 193, 99))), (F.col("l_partkey") % 6 + 1).cast("int")).alias("stream_id"))
    out = rows.join(F.broadcast(codecs), "stream_id", "left")
    return out.groupBy("stream_id", "codec", "mime", "pid").agg(F.count("*").alias("n")).select("*", F.col("codec").isin(*m.VALID_CODECS).alias("valid"), F.when(F.col("codec").isNull(), "unknown stream id").alias("err"))


def qtable_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 101).alias("quality")).distinct()
    return rows.select("quality", F.array_join(F.transform(m.quant_table(F.col("quality")), lambda v: v.cast("string")), ",").alias("table"))


def cameras(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of even and odd users are frames of the left and the right camera of one day; ``value`` is the angle.

    The angle is rounded as the SQL rounds it, which adds 360 to all values: angles half a turn apart go the long way round by their last digit.
    """
    e = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"), F.col("event_id").alias("frame"), (F.col("user_id") % 2).alias("side"), ((F.col("value") % 360 + 360) % 360).alias("angle"))
    return e.where("side = 0").drop("side"), e.where("side = 1").drop("side")


def sync_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy pairs within two minutes: the supplied events are far sparser than frames of a camera."""
    left, right = cameras(spark, sf_dir)
    return sync.greedy_pairs(left.select("day", "ms", "frame"), right.select("day", "ms", "frame"), "day", 120_000.0)


def sync_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = cameras(spark, sf_dir)
    nth = lambda df, a: df.withColumn("n", F.row_number().over(_by_day())).select("day", "n", F.col("angle").alias(a))
    pairs = nth(left, "l").join(nth(right, "r"), ["day", "n"]).select("day", sync.offset_ms(F.col("l"), F.col("r")).alias("offset"))
    out = sync.statistics(pairs, "offset", "day")
    return out.select("day", "frames", "filtered", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _by_day():
    from riffle.operators.ordered import window

    return window("day", "frame")


def iqr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.without_outliers(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "value", "event_type")


def clock_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("dx"), F.col("embedding")[1].cast("double").alias("dy"))
    return rows.select("vec_id", F.round(sync.angle(F.col("dx"), F.col("dy")), 6).alias("angle"))


def recording_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("user_id") % 2 == 0, "left_").otherwise("right_"), F.date_format("ts", "yyyyMMdd_HH"), F.lit("0000"), F.lit(".mkv")).alias("name")).distinct()
    return sync.file_pairs(names)


def marker_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eight components of a vector are the four points of a marker."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select((F.col("vec_id") * 8 + F.floor(F.col("i") / 8)).alias("marker"), "i", "v")
    points = rows.groupBy("marker", F.floor(F.col("i") / 2).alias("p")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("v").cast("double"))).alias("x"), F.max(F.when(F.col("i") % 2 == 1, F.col("v").cast("double"))).alias("y"))
    return sync.corners(points, "marker").select("marker", *[F.round(F.col(f"{c}.{a}"), 6).alias(f"{c}_{a}") for c in ("tl", "tr", "br", "bl") for a in ("x", "y")])


def largest_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal prices the first row of the table counts, as ``arg_max`` has it where it reads in order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("area"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return sync.largest(rows, "l_orderkey", "area", 30_000.0, ("file", "row"))


QUERIES = {f.__name__: f for f in (meta_encode, meta_edit, meta_parse, psi_with_meta, psi_edit, url_fields, rtsp_texts, codec_dim_join, qtable_scale, sync_pairs, sync_statistics, iqr_filter, clock_angles, recording_pairs, marker_corners, largest_contour)}

_KV = "r AS (SELECT *, 'cust=' || o_custkey || chr(9) || 'status=' || o_orderstatus || chr(9) || 'prio=' || o_orderpriority AS t FROM orders)"
_URL = """u AS (SELECT page_id, ['rtmp', 'rtmpt', 'rtmps', 'rtmpe', 'http', 'rtmp', 'rtmpts'][page_id % 7 + 1] AS scheme, regexp_replace(url, '^[a-z]+://', '') || ['/a.mp4', '/b.flv', '/c', '/mp3:d.mp3', '/e.f4v', '', '/f.mp3?key=1'][page_id % 5 + 1 + CASE WHEN page_id % 7 = 5 THEN 2 ELSE 0 END] AS rest FROM pages),
v AS (SELECT page_id, scheme || '://' || rest AS url, CASE scheme WHEN 'rtmp' THEN 0 WHEN 'rtmpt' THEN 1 WHEN 'rtmpe' THEN 2 WHEN 'rtmps' THEN 4 WHEN 'rtmpts' THEN 5 END AS num, regexp_extract(rest, '^[^/?#]*') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '\\?([^#]*)', 1) AS query FROM u),
w AS (SELECT *, regexp_extract(path, '^/([^/]*)', 1) AS a, regexp_extract(path, '^/[^/]+/(.*)$', 1) AS p0, regexp_extract(host, ':([0-9]+)$', 1) AS ep FROM v),
x AS (SELECT *, rtrim(regexp_replace(p0, '/+', '/', 'g'), '/') AS p FROM w), y AS (SELECT *, regexp_extract(p, '(\\.[^./]*)$', 1) AS ext, regexp_replace(p, '\\.[^./]*$', '') AS stem FROM x),
z AS (SELECT *, CASE WHEN num IS NULL THEN 'unknown scheme' WHEN NOT starts_with(path, '/') THEN 'invalid path' WHEN a = '' OR regexp_extract(p0, '^([^/]*)', 1) = '' THEN 'invalid elements' WHEN ep = '' AND (num & 4) <> 0 THEN 'ssl not implemented' END AS err FROM y)"""

ORACLES = {
    "meta_encode": f"WITH {_KV} SELECT o_orderkey, '0010' || printf('%04X', strlen(t)) || hex(encode(t)) AS meta FROM r",
    "meta_edit": "SELECT o_orderkey, 'status=X' || chr(9) || 'prio=' || o_orderpriority || chr(9) || 'ts=' || o_orderkey AS meta FROM orders",
    "meta_parse": "SELECT o_orderkey, CASE o_orderkey % 21 WHEN 0 THEN 'too short' WHEN 7 THEN 'wrong length' WHEN 14 THEN 'unexpected format' END AS err, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS prio, CASE WHEN o_orderkey % 7 <> 0 THEN 3 END AS n FROM orders",
    "psi_with_meta": f"WITH {_KV} SELECT o_orderkey, o_orderkey % 1000 + 1 AS program, '5,38' AS tags, t AS meta, CAST(NULL AS VARCHAR) AS err, strlen(t) + 33 AS size FROM r",
    "psi_edit": """SELECT o_orderkey, '02B0' || printf('%02X', 18 + 3) || printf('%04X', o_orderkey % 1000 + 1) || 'C10000E100F003' || '2601' || hex(encode(o_orderstatus)) || '1BE100F000' AS section, 4096 AS pmt_pid, 1 AS n_programs, '[{"type":27,"pid":256}]' AS streams FROM orders""",
    "url_fields": f"""WITH {_URL} SELECT page_id, url, CASE WHEN err IS NULL THEN num END AS protocol, CASE WHEN err IS NULL THEN host END AS host, CASE WHEN err IS NULL THEN CASE WHEN ep <> '' THEN CAST(ep AS INTEGER) WHEN (num & 1) <> 0 THEN 80 ELSE 1935 END END AS port, CASE WHEN err IS NULL THEN a END AS app,
CASE WHEN err IS NULL THEN CASE WHEN ext IN ('.mp4', '.f4v') THEN CASE WHEN starts_with(stem, 'mp4:') THEN stem ELSE 'mp4:' || stem END WHEN ext = '.mp3' THEN CASE WHEN starts_with(stem, 'mp3:') THEN stem ELSE 'mp3:' || stem END WHEN ext = '.flv' THEN stem ELSE p END || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS playpath, err FROM z""",
    "rtsp_texts": """SELECT page_id, 'SETUP ' || url || ' RTSP/1.0' || chr(13) || chr(10) || 'CSeq: ' || (page_id + 1) || chr(13) || chr(10) || 'Transport: RTP/AVP;unicast' || chr(13) || chr(10) || 'Session: ' || page_id || chr(13) || chr(10) || chr(13) || chr(10) AS request,
CASE WHEN page_id % 3 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 3 = 0 THEN 'Not Found' ELSE 'OK' END AS reason, 'PLAY|SETUP' AS public, CAST(page_id + 1 AS VARCHAR) AS cseq FROM pages""",
    "codec_dim_join": f"""WITH c(codec, mime, pid, stream_id) AS (VALUES {", ".join(map(str, m.CODECS))}), r AS (SELECT [27, 36, 136, 192, 193, 99][l_partkey % 6 + 1] AS stream_id FROM lineitem)
SELECT r.stream_id, codec, mime, pid, count(*) AS n, codec IN {m.VALID_CODECS} AS valid, CASE WHEN codec IS NULL THEN 'unknown stream id' END AS err FROM r LEFT JOIN c USING (stream_id) GROUP BY r.stream_id, codec, mime, pid""",
    "qtable_scale": f"""WITH q AS (SELECT DISTINCT l_partkey % 101 AS quality FROM lineitem), f AS (SELECT quality, CASE WHEN g < 50 THEN 5000 // g ELSE 200 - g * 2 END AS factor FROM (SELECT quality, greatest(1, least(99, quality)) AS g FROM q))
SELECT quality, array_to_string(list_transform({list(m.LUMA)}, lambda v: greatest(1, least(255, (v * factor + 50) // 100))), ',') AS "table" FROM f""",
    "sync_pairs": """WITH RECURSIVE e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) / 1000 AS ms, event_id AS frame, user_id % 2 AS side FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY day, side ORDER BY ms, frame) AS n FROM e),
s AS (SELECT day, 1::BIGINT AS i, 1::BIGINT AS j, NULL::BIGINT AS left_frame, NULL::BIGINT AS right_frame, NULL::DOUBLE AS gap_ms FROM (SELECT DISTINCT day FROM e) UNION ALL
SELECT s.day, i + CASE WHEN abs(l.ms - r.ms) <= 120000 OR l.ms < r.ms THEN 1 ELSE 0 END, j + CASE WHEN abs(l.ms - r.ms) <= 120000 OR l.ms >= r.ms THEN 1 ELSE 0 END,
 CASE WHEN abs(l.ms - r.ms) <= 120000 THEN l.frame END, CASE WHEN abs(l.ms - r.ms) <= 120000 THEN r.frame END, r.ms - l.ms
 FROM s JOIN o l ON l.day = s.day AND l.side = 0 AND l.n = s.i JOIN o r ON r.day = s.day AND r.side = 1 AND r.n = s.j)
SELECT day, left_frame, right_frame, gap_ms FROM s WHERE left_frame IS NOT NULL""",
    "sync_statistics": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id AS frame, user_id % 2 AS side, ((value % 360) + 360) % 360 AS a FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY day, side ORDER BY frame) AS n FROM e),
p AS (SELECT l.day, CASE WHEN r.a - l.a > 180 THEN r.a - l.a - 360 WHEN r.a - l.a < -180 THEN r.a - l.a + 360 ELSE r.a - l.a END / 360 * 1000 AS x FROM o l JOIN o r ON l.day = r.day AND l.n = r.n AND l.side = 0 AND r.side = 1),
q AS (SELECT day, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, count(*) AS frames FROM p GROUP BY day)
SELECT q.day, any_value(frames) AS frames, count(p.x) AS filtered, round(coalesce(avg(p.x), 0), 6) AS mean, round(coalesce(stddev_pop(p.x), 0), 6) AS std
FROM q LEFT JOIN p ON p.day = q.day AND p.x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY q.day""",
    "iqr_filter": """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, event_id, value FROM events JOIN q USING (event_type) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    "clock_angles": "SELECT vec_id, round((degrees(atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE))) + 360) % 360, 6) AS angle FROM embeddings",
    "recording_pairs": """WITH n AS (SELECT DISTINCT user_id % 2 AS side, strftime(ts, '%Y%m%d_%H') || '0000' AS t FROM events)
SELECT l.t AS "time", 'left_' || l.t || '.mkv' AS "left", 'right_' || l.t || '.mkv' AS "right" FROM n l JOIN n r ON l.t = r.t AND l.side = 0 AND r.side = 1""",
    "marker_corners": """WITH p AS (SELECT vec_id * 8 + k // 4 AS marker, {'x': CAST(embedding[2 * k + 1] AS DOUBLE), 'y': CAST(embedding[2 * k + 2] AS DOUBLE)} AS p FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 2)) AS k FROM embeddings)),
c AS (SELECT marker, arg_min(p, p.x + p.y) AS tl, arg_min(p, p.y - p.x) AS tr, arg_max(p, p.x + p.y) AS br, arg_max(p, p.y - p.x) AS bl FROM p GROUP BY marker)
SELECT marker, round(tl.x, 6) AS tl_x, round(tl.y, 6) AS tl_y, round(tr.x, 6) AS tr_x, round(tr.y, 6) AS tr_y, round(br.x, 6) AS br_x, round(br.y, 6) AS br_y, round(bl.x, 6) AS bl_x, round(bl.y, 6) AS bl_y FROM c""",
    "largest_contour": "SELECT l_orderkey, arg_max(l_linenumber, l_extendedprice) AS l_linenumber, max(CAST(l_extendedprice AS DOUBLE)) AS area FROM lineitem WHERE l_extendedprice > 30000 GROUP BY l_orderkey",
}
