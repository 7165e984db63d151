"""Queries over whole transport streams: the turns of each conversation are the frames of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import packing as pk
from riffle.operators import transport as tr
from riffle.operators.ordered import window
from riffle.plans.packet_queries import _TS, ts_stream
from riffle.session import table


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def ts_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole streams of packets, with tables every 0.08 seconds."""
    out = tr.encoded(frames(spark, sf_dir), "conv_id", "turn", "data", rate=25, tables="seconds", every=0.08)
    return out.select("conv_id", "turn", "sub", "pid", F.octet_length("packet").alias("size"), F.sha2("packet", 256).alias("sha256"))


def ts_tables_by_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whenever ten packets were written since the last ones."""
    out = tr.encoded(frames(spark, sf_dir), "conv_id", "turn", "data", tables="packets", every=10)
    return out.groupBy("conv_id").agg(F.count("*").alias("n_packets"), F.sum((F.col("pid") == 0).cast("int")).alias("n_tables"), F.max(F.when(F.col("pid") == 0, F.col("turn"))).alias("last_table"))


def demux_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams packed with metadata and taken apart again; the time in it is that of the frame behind the tables."""
    kv = F.array(F.struct(F.lit("conv").alias("k"), F.col("conv_id").cast("string").alias("v")), F.struct(F.lit("role").alias("k"), F.col("role").alias("v")))
    rows = frames(spark, sf_dir).withColumn("kv", tr.with_time(kv, F.col("turn") + 1_700_000_000))
    packed = tr.encoded(rows, "conv_id", "turn", "data", rate=25, tables="seconds", every=0.08, meta=F.col("kv"))
    out = tr.demuxed(packed, "conv_id", "turn", "sub")
    return out.select("conv_id", "n", "pts", "stream_id", "meta", "idx", "err", F.octet_length("data").alias("size"), F.sha2("data", 256).alias("sha256"))


def raw_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = tr.encoded(frames(spark, sf_dir), "conv_id", "turn", "data", tables="seconds", every=0.08)
    return tr.raw_media(packed, 256, "conv_id", "turn", "sub").select("conv_id", F.octet_length("data").alias("size"), F.sha2("data", 256).alias("sha256"))


def pts_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of an interval, and why some streams have none."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 3600 + F.col("conv_id") % 3 * 7200).alias("pts"))
    return tr.trimmed(rows, 5000, 9000, "conv_id", "turn")


def packet_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets without an adaptation field get one, flags of others go, counters and the discontinuity bit are set."""
    bare = F.overlay("packet", F.unhex(F.lit("10")), F.lit(4), F.lit(1))
    rows = ts_stream(spark, sf_dir).withColumn("packet", F.when(F.col("seq") % 2 == 0, bare).otherwise(F.col("packet")))
    rows = rows.select("doc_id", "seq", tr.with_adaptation(F.col("packet")).alias("added"), tr.without_flags(F.col("packet")).alias("cleared"), tr.with_counter(F.col("packet"), F.col("seq") + 5).alias("counted"), tr.with_discontinuity(F.col("packet"), F.lit(True)).alias("marked"))
    return rows.select("doc_id", "seq", *[F.sha2(c, 256).alias(c) for c in ("added", "cleared", "counted", "marked")])


def old_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that hold a time and a location right behind the pointer, read and changed."""
    place = F.col("url")
    held = F.concat(pk.descriptor(234, F.unhex(F.lpad(F.hex(F.col("page_id")), 16, "0"))), pk.descriptor(235, tr.padded(F.encode(F.substring(place, 1, 20), "UTF-8"), 32, 0)))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.unhex(F.lit("00")), pk.pmt(1, 256, F.when(F.col("page_id") % 4 > 0, held).otherwise(F.lit(b"")), 27)).alias("t"))
    rows = rows.withColumn("new", tr.with_new_place(tr.with_new_time(F.col("t"), F.col("page_id") + 7), F.concat(F.lit("at "), F.substring(place, 1, 40))))
    return rows.select("page_id", tr.has_time(F.col("t")).alias("has_time"), tr.place_of(F.col("t")).alias("place"), tr.section_length(F.col("t")).alias("length"), tr.place_of(F.col("new")).alias("new_place"), F.hex(F.substring("new", 16, 8)).alias("new_time"), (tr.crc32_mpeg2(F.expr("substring(new, 2)")) == 0).alias("crc_fits"))


def rtmp_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every message: headers by what it shares with the one before, bodies in chunks of 128."""
    w = window("conv_id", "turn")
    rows = frames(spark, sf_dir).select("conv_id", "turn", "data", F.octet_length("data").alias("size"), (F.col("turn") * 40).cast("long").alias("ms"), F.when(F.col("role") == "user", 8).otherwise(9).alias("type"))
    rows = rows.withColumn("delta", F.col("ms") - F.lag("ms").over(w))
    alike = F.coalesce((F.lag("size").over(w) == F.col("size")) & (F.lag("type").over(w) == F.col("type")), F.lit(False))
    same = F.coalesce(F.lag("delta").over(w) == F.col("delta"), F.lit(False))
    rows = rows.withColumn("kind", pk.rtmp_header_size(F.col("delta").isNotNull(), alike, same))
    out = tr.rtmp_chunks(F.col("kind"), F.lit(1), 4, F.col("ms"), F.coalesce("delta", F.lit(0)), F.col("size"), F.col("type"), F.col("data"))
    return rows.select("conv_id", "turn", "kind", F.sha2(out, 256).alias("sha256"))


def flv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole FLV files: header, and a video and an audio tag for each turn."""
    rows = frames(spark, sf_dir)
    tags = F.array(F.struct(F.lit(0).alias("sub"), pk.flv_video_tag(F.col("turn") * 40, F.col("role") == "user", 7, 1, F.col("data")).alias("tag")), F.struct(F.lit(1).alias("sub"), pk.flv_audio_tag(F.col("turn") * 40, 0xAF, F.unhex(F.lit("0121"))).alias("tag")))
    rows = rows.select("conv_id", "turn", F.inline(tags))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "sub", "tag"))).alias("t"))
    data = F.concat(tr.flv_header(), tr.one_after_another(F.transform("t", lambda x: x["tag"])))
    return whole.select("conv_id", data.alias("data")).select("conv_id", F.octet_length("data").alias("size"), F.sha2("data", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (ts_encode, ts_tables_by_packets, demux_frames, raw_media, pts_trim, packet_edits, old_tables, rtmp_bytes, flv_files)}

# Packets of the tables behind their counters, without the padding.
_PAT, _PMT = "0000B00D0001C100000001F0002AB104B2", "0002B0120001C10000E100F0001BE100F00015BD4D56"
_F = "f AS (SELECT conv_id, turn, role, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"
_N = "n AS (SELECT *, 1 + (greatest(0, len + 14 - 176) + 181) // 182 AS n, i % 2 = 0 AS tables FROM f)"
_P33 = "printf('%010X', (2::BIGINT << 36) | ((({v} >> 30) & 7) << 33) | ((({v} >> 15) & 32767) << 17) | (({v} & 32767) << 1) | 4295032833)"
_LE = "printf('%02X%02X%02X%02X', 1, 0, 0, 0)"

ORACLES = {
    "ts_encode": f"""WITH {_F}, {_N}, s AS (SELECT *, sum(n) OVER w - n AS before, sum(CAST(tables AS INTEGER)) OVER w - 1 AS psi, '000001' || '1B' || '0000808005' || {_P33.format(v='(i * 3600 + 63000)')} || h AS p FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
q AS (SELECT *, unnest(range(0, n)) AS j FROM s), d AS (SELECT *, CASE WHEN j = 0 THEN substring(p, 1, 352) ELSE substring(p, CAST(353 + (j - 1) * 364 AS BIGINT), 364) END AS d FROM q),
x AS (SELECT conv_id, turn, j + 2 AS sub, 256 AS pid, '47' || CASE WHEN j = 0 THEN '4100' ELSE '0100' END || printf('%02X', CAST(48 + (before + j) % 16 AS BIGINT)) || printf('%02X', 183 - len(d) // 2) || CASE WHEN j = 0 THEN '10' || printf('%012X', ((i * 3600) << 15) | 32256) ELSE '00' END
  || repeat('FF', CAST(182 - CASE WHEN j = 0 THEN 6 ELSE 0 END - len(d) // 2 AS BIGINT)) || d AS x FROM d
  UNION ALL SELECT conv_id, turn, 0, 0, '474000' || printf('%02X', CAST(16 + psi % 16 AS BIGINT)) || '{_PAT}' || repeat('FF', 184 - {len(_PAT) // 2}) FROM s WHERE tables
  UNION ALL SELECT conv_id, turn, 1, 4096, '475000' || printf('%02X', CAST(16 + psi % 16 AS BIGINT)) || '{_PMT}' || repeat('FF', 184 - {len(_PMT) // 2}) FROM s WHERE tables)
SELECT conv_id, turn, CAST(sub AS INTEGER) AS sub, CAST(pid AS INTEGER) AS pid, CAST(len(x) // 2 AS INTEGER) AS size, sha256(unhex(x)) AS sha256 FROM x""",
    "ts_tables_by_packets": f"""WITH RECURSIVE {_F}, {_N}, r AS (SELECT conv_id, i, turn, n, true AS flag, 2 + n AS written FROM n WHERE i = 0 UNION ALL
 SELECT n.conv_id, n.i, n.turn, n.n, r.written >= 10, CASE WHEN r.written >= 10 THEN 2 ELSE r.written END + n.n FROM r JOIN n ON n.conv_id = r.conv_id AND n.i = r.i + 1)
SELECT conv_id, CAST(sum(n) + 2 * count(*) FILTER (flag) AS BIGINT) AS n_packets, count(*) FILTER (flag) AS n_tables, max(turn) FILTER (flag) AS last_table FROM r GROUP BY conv_id""",
    "demux_frames": f"""WITH {_F}, m AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY i) - len AS idx, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS role0, lag(turn) OVER (PARTITION BY conv_id ORDER BY i) AS turn0 FROM f)
SELECT conv_id, i AS n, i * 3600 + 63000 AS pts, 27::BIGINT AS stream_id, 'conv=' || conv_id || chr(9) || 'role=' || CASE WHEN i % 2 = 0 THEN role ELSE role0 END || chr(9) || 'ts=' || (1700000000 + CASE WHEN i % 2 = 0 THEN turn ELSE turn0 END) AS meta,
 CAST(idx AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS err, len AS size, sha256(unhex(h)) AS sha256 FROM m""",
    "raw_media": f"WITH {_F} SELECT conv_id, CAST(sum(len) AS INTEGER) AS size, sha256(unhex(string_agg(h, '' ORDER BY i))) AS sha256 FROM f GROUP BY conv_id",
    "pts_trim": """WITH r AS (SELECT conv_id, turn, turn * 3600 + conv_id % 3 * 7200 AS pts FROM conversations), a AS (SELECT *, lead(pts) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM r),
s AS (SELECT conv_id, min(turn) FILTER (after > 5000) AS first FROM a GROUP BY conv_id), e AS (SELECT s.conv_id, s.first, (SELECT min(turn) FROM a WHERE a.conv_id = s.conv_id AND a.turn >= s.first AND a.after >= 9000) AS last FROM s)
SELECT conv_id, CASE WHEN last IS NOT NULL THEN CAST(first AS BIGINT) END AS first, CAST(last AS BIGINT) AS last, CASE WHEN first IS NULL THEN 'PTS ''from'' cannot be found' WHEN last IS NULL THEN 'PTS ''to'' cannot be found' END AS err FROM e""",
    "packet_edits": f"""WITH {_TS}, y AS (SELECT doc_id, seq, CASE WHEN seq % 2 = 0 THEN substring(x, 1, 6) || '10' || substring(x, 9) ELSE x END AS x FROM pkt)
SELECT doc_id, seq, CASE WHEN seq % 2 = 0 THEN sha256(unhex(substring(x, 1, 6) || '300100' || substring(x, 9, 364))) END AS added, CASE WHEN seq % 2 = 1 THEN sha256(unhex(substring(x, 1, 8) || '0100' || substring(x, 13))) END AS cleared,
 sha256(unhex(substring(x, 1, 6) || CASE WHEN seq % 2 = 0 THEN '1' ELSE '3' END || printf('%X', (seq + 5) % 16) || substring(x, 9))) AS counted,
 CASE WHEN seq % 2 = 1 AND substring(x, 9, 2) <> '00' THEN sha256(unhex(substring(x, 1, 10) || CASE substring(x, 11, 1) WHEN '1' THEN '9' ELSE '8' END || substring(x, 12))) END AS marked FROM y""",
    "old_tables": """SELECT page_id, page_id % 4 > 0 AS has_time, CASE WHEN page_id % 4 > 0 THEN substring(url, 1, 20) END AS place, CAST(18 + CASE WHEN page_id % 4 > 0 THEN 44 ELSE 0 END AS BIGINT) AS length,
 CASE WHEN page_id % 4 > 0 THEN substring('at ' || substring(url, 1, 40), 1, 32) END AS new_place, CASE WHEN page_id % 4 > 0 THEN printf('%016X', page_id + 7) END AS new_time, CASE WHEN page_id % 4 > 0 THEN true END AS crc_fits FROM pages""",
    "rtmp_bytes": f"""WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 8 ELSE 9 END AS ty, strlen(coalesce(text, '')) AS size, hex(encode(coalesce(text, ''))) AS h, CAST(turn * 40 AS BIGINT) AS ms FROM conversations),
d AS (SELECT *, ms - lag(ms) OVER w AS delta, lag(size) OVER w = size AND lag(ty) OVER w = ty AS alike FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, CASE WHEN delta IS NULL THEN 12 WHEN NOT coalesce(alike, false) THEN 8 WHEN NOT coalesce(lag(delta) OVER (PARTITION BY conv_id ORDER BY turn) = delta, false) THEN 4 ELSE 1 END AS kind FROM d),
b AS (SELECT *, array_to_string(list_transform(range(0, (size + 127) // 128), lambda k: substring(h, k * 256 + 1, 256)), 'C4') AS body FROM e)
SELECT conv_id, turn, kind, sha256(unhex(CASE kind WHEN 12 THEN '04' || printf('%06X', ms) WHEN 8 THEN '44' || printf('%06X', delta) WHEN 4 THEN '84' || printf('%06X', delta) ELSE 'C4' END
  || CASE WHEN kind > 4 THEN printf('%06X', size) || printf('%02X', ty) ELSE '' END || CASE WHEN kind > 8 THEN {_LE} ELSE '' END || coalesce(body, ''))) AS sha256 FROM b""",
    "flv_files": """WITH r AS (SELECT conv_id, turn, role, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM conversations),
t AS (SELECT conv_id, turn, '09' || printf('%06X', n + 5) || printf('%06X', turn * 40) || '00000000' || CASE WHEN role = 'user' THEN '17' ELSE '27' END || '01000000' || h || printf('%08X', n + 16) || '08000003' || printf('%06X', turn * 40) || '00000000AF01210000000E' AS x FROM r)
SELECT conv_id, CAST(13 + sum(len(x) // 2) AS INTEGER) AS size, sha256(unhex('464C5601050000000900000000' || string_agg(x, '' ORDER BY turn))) AS sha256 FROM t GROUP BY conv_id""",
}
