"""Byte queries: whole texts are media, cut into packets, packed, read back and put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import bytesx as b
from riffle.functions import packing as pk
from riffle.functions import parsing as ps
from riffle.operators.ordered import window
from riffle.plans.views import PACKETS_SQL, packets
from riffle.session import table


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def byte_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media(spark, sf_dir).select("doc_id", F.posexplode(b.chunks(F.col("data"), 1316)).alias("n", "piece"))
    return rows.select("doc_id", "n", F.octet_length("piece").alias("size"), F.sha2("piece", 256).alias("sha256"))


def scan_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media(spark, sf_dir).select("doc_id", F.posexplode(b.split_after(F.col("data"), 10)).alias("n", "piece"))
    return rows.select("doc_id", "n", F.octet_length("piece").alias("size"), F.sha2("piece", 256).alias("sha256"))


def crc32_mpeg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", b.crc32_mpeg2(F.encode("url", "UTF-8")).alias("crc"))


def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.hex(b.padded(F.encode("url", "UTF-8"), 184)).alias("padded"))


def uint_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7_919 + F.col("l_partkey")).alias("v"))
    packed = rows.withColumn("p24", F.unhex(b.put_be(F.col("v"), 3))).withColumn("p32", F.unhex(b.put_le(F.col("v"), 4)))
    return packed.select("l_orderkey", "l_linenumber", F.hex("p24").alias("be24"), b.be(F.col("p24"), 0, 3).alias("v24"), F.hex("p32").alias("le32"), b.le(F.col("p32"), 0, 4).alias("v32"), F.greatest(F.lit(1), F.least(F.lit(255), F.col("v") % 400)).alias("clipped"))


def ts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as one PES packet in transport packets: ``doc_id, seq, packet``."""
    rows = media(spark, sf_dir).select("doc_id", pk.pes(0xE0, F.col("doc_id") * 3600, F.col("data")).alias("pes"))
    rows = rows.select("doc_id", F.posexplode(pk.ts_pieces(F.col("pes"))).alias("seq", "piece"))
    return rows.select("doc_id", "seq", pk.ts_packet(256, F.col("seq") == 0, F.col("seq"), F.when(F.col("seq") == 0, F.col("doc_id") * 3600), F.col("piece")).alias("packet"))


def ts_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts_stream(spark, sf_dir).select("doc_id", "seq", F.octet_length("packet").alias("size"), F.sha2("packet", 256).alias("sha256"))


def ts_packet_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("data") + 14
    return media(spark, sf_dir).select("doc_id", (F.ceil(F.greatest(F.lit(0), n - pk.TS_ROOM_PCR) / pk.TS_ROOM) + 1).alias("n_packets"))


def ts_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ps.ts_fields(F.col("packet"))
    return ts_stream(spark, sf_dir).select("doc_id", "seq", *[f[c].alias(c) for c in ("pid", "pusi", "cc", "afc", "discontinuity", "pcr", "err")], F.octet_length(f["payload"]).alias("payload_size"))


def frames_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames start with the unit start; payloads are joined in order, the PES header read, and the media comes out whole."""
    f = ps.ts_fields(F.col("packet"))
    rows = ts_stream(spark, sf_dir).select("doc_id", "seq", f["pusi"].alias("pusi"), f["payload"].alias("payload"))
    rows = rows.withColumn("frame", F.sum(F.col("pusi").cast("int")).over(window("doc_id", "seq")))
    whole = rows.groupBy("doc_id", "frame").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("parts"))
    whole = whole.select("doc_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), "")).alias("pes"))
    g = ps.pes_fields(F.col("pes"))
    return whole.select("doc_id", g["stream_id"].alias("stream_id"), g["pts"].alias("pts"), F.octet_length(g["data"]).alias("size"), F.sha2(g["data"], 256).alias("sha256"))


def di_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets after a gap get the discontinuity bit, by editing one byte."""
    rows = packets(spark, sf_dir).select("pid", "off", "cc", pk.ts_packet(F.col("pid"), F.col("pusi"), F.col("cc"), F.lit(None).cast("long"), F.encode(F.col("event_type"), "UTF-8")).alias("packet"))
    gap = F.coalesce(F.col("cc") != (F.lag("cc").over(window("pid", "off")) + 1) % 16, F.lit(False))
    edited = F.when(gap, F.overlay("packet", F.unhex(b.put_be(b.u8(F.col("packet"), 5).bitwiseOR(F.lit(0x80)), 1)), F.lit(6), F.lit(1))).otherwise(F.col("packet"))
    f = ps.ts_fields(F.col("edited"))
    return rows.withColumn("edited", edited).select("pid", "off", f["pid"].alias("read_pid"), f["cc"].alias("cc"), f["discontinuity"].alias("discontinuity"))


def rtp_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media(spark, sf_dir).select("doc_id", F.posexplode(b.chunks(F.col("data"), 1316)).alias("n", "piece"))
    last = F.lead("n").over(window("doc_id", "n")).isNull()
    return rows.select("doc_id", "n", pk.rtp_packet(last, 33, F.col("n") + 65_530, F.col("n") * 3600, F.col("doc_id"), F.col("piece"), F.array(F.lit(7), F.col("doc_id")), F.unhex(F.lit("01020304"))).alias("packet"))


def rtp_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ps.rtp_fields(F.col("packet"))
    return rtp_stream(spark, sf_dir).select("doc_id", "n", *[f[c].alias(c) for c in ("marker", "seq", "rtp_ts", "ssrc", "n_csrc", "err")], F.octet_length(f["payload"]).alias("size"), F.sha2(f["payload"], 256).alias("sha256"))


def rtp_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are buffered until there are 1316 bytes, then all is sent: a batch ends where the running sum has grown past the threshold."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "size"))).alias("t"))
    kind = "struct<held:bigint,sent:array<bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("sent")).cast(kind)

    def take(s, x):
        held = s["held"] + x["size"]
        return F.when(held >= 1316, F.struct(F.lit(0).cast("long").alias("held"), F.concat(s["sent"], F.array(held)).alias("sent")).cast(kind)).otherwise(F.struct(held.alias("held"), s["sent"].alias("sent")).cast(kind))

    out = turns.select("conv_id", F.aggregate("t", start, take).alias("s"))
    return out.select("conv_id", F.size("s.sent").alias("n_sent"), F.aggregate("s.sent", F.lit(0).cast("long"), lambda a, v: a + F.ceil(v / 1316)).alias("n_packets"), F.col("s.held").alias("held"))


def rtcp_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packets(spark, sf_dir).select("pid", "off", "ts_us", "pts")
    sec = F.expr("ts_us div 1000000 + 2208988800")
    frac = F.floor(F.expr("ts_us % 1000000") * 4_294_967_296 / 1_000_000).cast("long")
    sr = pk.rtcp_sender_report(F.col("pid"), sec, frac, F.col("pts") % 4_294_967_296, F.col("off"), F.col("off") * 188)
    rows = rows.withColumn("sr", sr).withColumn("t", ps.sender_report_time(F.col("sr")))
    rr = pk.rtcp_receiver_report(F.lit(1), F.col("pid"), F.col("off"), F.col("t.seconds") % 65_536 * 65_536 + F.shiftright(F.col("t.fraction"), 16), F.lit(0))
    name = pk.rtcp_description(F.col("pid"), F.encode(F.concat(F.lit("cam"), F.col("off").cast("string")), "UTF-8"))
    return rows.select("pid", "off", ps.ntp_micros(F.col("t.seconds"), F.col("t.fraction")).alias("ts_us"), F.hex(rr).alias("rr"), F.hex(name).alias("sdes"))


def flv_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    video = rows.select("conv_id", "turn", F.lit(0).alias("sub"), pk.flv_video_tag(F.col("turn") * 40, F.col("role") == "user", 7, 1, F.col("data")).alias("tag"))
    audio = rows.select("conv_id", "turn", F.lit(1).alias("sub"), pk.flv_audio_tag(F.col("turn") * 40, 0xAF, F.unhex(F.lit("0121"))).alias("tag"))
    return video.unionByName(audio).select("conv_id", "turn", "sub", F.octet_length("tag").alias("size"), F.hex(F.substring("tag", 1, 16)).alias("head"), F.hex(F.expr("substring(tag, -4, 4)")).alias("previous_size"))


def rtmp_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header bytes and chunks of 128 bytes of each message, by what it shares with the one before on its channel."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), (F.col("turn") * 40).alias("ms"))
    w = window("conv_id", "turn")
    rows = rows.withColumn("delta", F.col("ms") - F.lag("ms").over(w)).withColumn("seen", F.lag("ms").over(w).isNotNull())
    alike = (F.lag("size").over(w) == F.col("size")) & (F.lag("role").over(w) == F.col("role"))
    rows = rows.withColumn("alike", F.coalesce(alike, F.lit(False))).withColumn("same", F.coalesce(F.lag("delta").over(w) == F.col("delta"), F.lit(False)))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("size") / 128))
    return rows.select("conv_id", "turn", pk.rtmp_header_size(F.col("seen"), F.col("alike"), F.col("same")).alias("header"), chunks.alias("n_chunks"), (F.col("size") + chunks - 1).alias("body"))


def aac_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 4).alias("profile"), (F.col("l_partkey") % 13).alias("rate"), (F.col("l_linenumber") % 8).alias("channels"))
    return rows.select("l_orderkey", "l_linenumber", F.hex(pk.audio_specific_config(F.col("profile"), F.col("rate"), F.col("channels"))).alias("config"))


QUERIES = {f.__name__: f for f in (byte_chunks, scan_until, crc32_mpeg2, padding, uint_packing, ts_packets, ts_packet_count, ts_headers, frames_reassembled, di_update, rtp_headers, rtp_rechunk, rtcp_reports, flv_tags, rtmp_chunks, aac_config)}

_HEX = "hx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)"
_CUT = "cut AS (SELECT doc_id, n, substring(h, CAST(n * 2632 + 1 AS BIGINT), 2632) AS h, n = m - 1 AS last FROM (SELECT doc_id, h, (len(h) + 2631) // 2632 AS m, unnest(range(0, (len(h) + 2631) // 2632)) AS n FROM hx))"
_P33 = "printf('%010X', (2::BIGINT << 36) | ((({v} >> 30) & 7) << 33) | ((({v} >> 15) & 32767) << 17) | (({v} & 32767) << 1) | 4295032833)"
_TS = f"""{_HEX}, pe AS (SELECT doc_id, '000001E00000808005' || {_P33.format(v='(doc_id * 3600)')} || h AS p FROM hx),
tp AS (SELECT doc_id, CAST(n AS INTEGER) AS seq, CASE WHEN n = 0 THEN substring(p, 1, 352) ELSE substring(p, 353 + (n - 1) * 364, 364) END AS d FROM
  (SELECT doc_id, p, unnest(range(0, 1 + (greatest(0, len(p) // 2 - 176) + 181) // 182)) AS n FROM pe)),
pkt AS (SELECT doc_id, seq, d, '47' || CASE WHEN seq = 0 THEN '4100' ELSE '0100' END || printf('%02X', 48 + seq % 16) || printf('%02X', 183 - len(d) // 2) || CASE WHEN seq = 0 THEN '10' || printf('%012X', ((doc_id * 3600) << 15) | 32256) ELSE '00' END
  || repeat('FF', 182 - CASE WHEN seq = 0 THEN 6 ELSE 0 END - len(d) // 2) || d AS x FROM tp)"""

ORACLES = {
    "byte_chunks": f"WITH {_HEX}, {_CUT} SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(len(h) // 2 AS INTEGER) AS size, sha256(unhex(h)) AS sha256 FROM cut",
    "scan_until": """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''), e AS (SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS x, len(l) AS m FROM p),
s AS (SELECT doc_id, n, CASE WHEN n < m - 1 THEN x || chr(10) ELSE x END AS x FROM e) SELECT doc_id, CAST(n AS INTEGER) AS n, strlen(x) AS size, sha256(x) AS sha256 FROM s WHERE x <> ''""",
    "crc32_mpeg2": """WITH RECURSIVE c AS (SELECT page_id, hex(encode(url)) AS h, 0 AS i, 4294967295::BIGINT AS c, 0 AS k FROM pages UNION ALL
SELECT page_id, h, CASE WHEN k = 7 THEN i + 1 ELSE i END, CASE WHEN (y & 2147483648) <> 0 THEN xor(y * 2, 79764919) & 4294967295 ELSE (y * 2) & 4294967295 END, (k + 1) % 8
FROM (SELECT *, CASE WHEN k = 0 THEN xor(c, CAST(('0x' || substring(h, i * 2 + 1, 2)) AS BIGINT) << 24) ELSE c END AS y FROM c WHERE i < len(h) // 2)) SELECT page_id, c AS crc FROM c WHERE i = len(h) // 2""",
    "padding": "SELECT page_id, hex(encode(url)) || repeat('FF', greatest(0, 184 - strlen(url))) AS padded FROM pages",
    "uint_packing": """WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7919 + l_partkey AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, printf('%06X', v & 16777215) AS be24, v & 16777215 AS v24, printf('%02X%02X%02X%02X', v & 255, (v >> 8) & 255, (v >> 16) & 255, (v >> 24) & 255) AS le32, v & 4294967295 AS v32, greatest(1, least(255, v % 400)) AS clipped FROM r""",
    "ts_packets": f"WITH {_TS} SELECT doc_id, seq, CAST(len(x) // 2 AS INTEGER) AS size, sha256(unhex(x)) AS sha256 FROM pkt",
    "ts_packet_count": "SELECT doc_id, 1 + (greatest(0, strlen(coalesce(text, '')) + 14 - 176) + 181) // 182 AS n_packets FROM documents",
    "ts_headers": f"WITH {_TS} SELECT doc_id, seq, 256::BIGINT AS pid, seq = 0 AS pusi, CAST(seq % 16 AS BIGINT) AS cc, 3::BIGINT AS afc, false AS discontinuity, CASE WHEN seq = 0 THEN doc_id * 3600 END AS pcr, CAST(NULL AS VARCHAR) AS err, CAST(len(d) // 2 AS INTEGER) AS payload_size FROM pkt",
    "frames_reassembled": "SELECT doc_id, 224::BIGINT AS stream_id, doc_id * 3600 AS pts, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "di_update": f"WITH {PACKETS_SQL} SELECT pid, off, pid AS read_pid, cc, coalesce(cc <> (lag(cc) OVER (PARTITION BY pid ORDER BY off) + 1) % 16, false) AS discontinuity FROM packets",
    "rtp_headers": f"WITH {_HEX}, {_CUT} SELECT doc_id, CAST(n AS INTEGER) AS n, last AS marker, (n + 65530) % 65536 AS seq, n * 3600 AS rtp_ts, doc_id AS ssrc, 2::BIGINT AS n_csrc, CAST(NULL AS VARCHAR) AS err, CAST(len(h) // 2 AS INTEGER) AS size, sha256(unhex(h)) AS sha256 FROM cut",
    "rtp_rechunk": """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, strlen(coalesce(text, ''))) AS i, strlen(coalesce(text, '')) AS size FROM conversations),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0::BIGINT AS held, 0 AS n_sent, 0::BIGINT AS n_packets FROM t UNION ALL
SELECT s.conv_id, t.i, CASE WHEN held + size >= 1316 THEN 0 ELSE held + size END, n_sent + CASE WHEN held + size >= 1316 THEN 1 ELSE 0 END, n_packets + CASE WHEN held + size >= 1316 THEN (held + size + 1315) // 1316 ELSE 0 END FROM s JOIN t ON t.conv_id = s.conv_id AND t.i = s.i + 1)
SELECT conv_id, arg_max(n_sent, i) AS n_sent, arg_max(n_packets, i) AS n_packets, arg_max(held, i) AS held FROM s GROUP BY conv_id""",
    "rtcp_reports": f"""WITH {PACKETS_SQL}, s AS (SELECT pid, off, ts_us, ts_us // 1000000 + 2208988800 AS sec, CAST(floor((ts_us % 1000000) * 4294967296 / 1000000) AS BIGINT) AS frac, 'cam' || off AS name FROM packets)
SELECT pid, off, ts_us, '81C90007' || printf('%08X', 1) || printf('%08X', pid) || 'FFFFFFFF' || printf('%08X', off) || '00000000' || printf('%08X', (sec % 65536) * 65536 + (frac >> 16)) || '00000000' AS rr,
'81CA' || printf('%04X', (2 + strlen(name) + 4 - (2 + strlen(name)) % 4) // 4 + 1) || printf('%08X', pid) || '01' || printf('%02X', strlen(name)) || hex(encode(name)) || repeat('00', CAST(4 - (2 + strlen(name)) % 4 AS BIGINT)) AS sdes FROM s""",
    "flv_tags": """WITH r AS (SELECT conv_id, turn, role, encode(coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS n FROM conversations)
SELECT conv_id, turn, 0 AS sub, n + 20 AS size, substring('09' || printf('%06X', n + 5) || printf('%06X', turn * 40) || '00000000' || CASE WHEN role = 'user' THEN '17' ELSE '27' END || '01000000' || hex(d) || printf('%08X', n + 16), 1, 32) AS head, printf('%08X', n + 16) AS previous_size FROM r
UNION ALL SELECT conv_id, turn, 1, 18, '08000003' || printf('%06X', turn * 40) || '00000000AF01210000', '0000000E' FROM r""",
    "rtmp_chunks": """WITH r AS (SELECT conv_id, turn, role, strlen(coalesce(text, '')) AS size, turn * 40 AS ms FROM conversations),
d AS (SELECT *, ms - lag(ms) OVER w AS delta, lag(size) OVER w = size AND lag(role) OVER w = role AS alike FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, lag(delta) OVER (PARTITION BY conv_id ORDER BY turn) = delta AS same FROM d)
SELECT conv_id, turn, CASE WHEN delta IS NULL THEN 12 WHEN NOT coalesce(alike, false) THEN 8 WHEN NOT coalesce(same, false) THEN 4 ELSE 1 END AS header, greatest(1, (size + 127) // 128) AS n_chunks, size + greatest(1, (size + 127) // 128) - 1 AS body FROM e""",
    "aac_config": "SELECT l_orderkey, l_linenumber, printf('%04X', ((l_orderkey % 4 + 1) << 11) | ((l_partkey % 13) << 7) | ((l_linenumber % 8) << 3)) AS config FROM lineitem",
}
