"""Splitters and reassembly: turns of conversations are NAL units, AAC frames, images and RTP packets, and come out whole again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import splitting as sp
from riffle.functions.bytesx import chunks, put_be
from riffle.operators import reassembly
from riffle.operators.ordered import window
from riffle.session import table

PIECE = 50


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def _x(*parts) -> F.Column:
    return F.concat(*[F.unhex(F.lit(p)) if isinstance(p, str) else p for p in parts])


def _stream(rows: DataFrame, piece) -> DataFrame:
    """The pieces of each conversation one after another."""
    parts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.hex(piece).alias("h")))).alias("p"))
    return parts.select("conv_id", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("data"))


def nal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPS and PPS before each fifth turn, IDR slices of users and other slices of the rest, with start codes of both lengths."""
    heads = F.when(F.col("turn") % 5 == 0, _x("0000000167414200", "0000000168CE")).otherwise(F.lit(b""))
    return _stream(turns(spark, sf_dir), _x(heads, "00000001", F.when(F.col("role") == "user", F.unhex(F.lit("65"))).otherwise(F.unhex(F.lit("41"))), F.col("data")))


def h264_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access units end after slices, SEI and PPS; the last one is not complete unless it ends so."""
    rows = nal_stream(spark, sf_dir).select("conv_id", F.posexplode(sp.nal_units(F.col("data"))).alias("pos", "u"))
    w = window("conv_id", "pos")
    rows = rows.withColumn("cut", F.col("u.type").isin(1, 5, 6, 8)).withColumn("unit", F.sum(F.coalesce(F.lag("cut").over(w), F.lit(False)).cast("int")).over(w))
    return rows.groupBy("conv_id", "unit").agg(F.count("*").alias("nals"), F.max_by("u.type", "pos").alias("last_type"), F.max_by("cut", "pos").alias("complete"), F.sum(F.octet_length("u.nal")).alias("n_bytes"))


def h264_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nal_stream(spark, sf_dir).select("conv_id", "data", sp.nal_units(F.col("data")).alias("u"))
    return rows.select("conv_id", sp.nal_type(F.col("u")).alias("nal_type"), sp.is_key_frame(F.col("u")).alias("key"), sp.has_sequence_header(F.col("u")).alias("sequence_header"), F.size("u").alias("n_units"), F.octet_length(sp.from_sps(F.col("data"))).alias("from_sps"))


def adts_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in frames of at most 8000 bytes of payload, as the length field has 13 bits."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(chunks(F.col("data"), 8000)).alias("i", "data")).select("conv_id", (F.col("turn") * 100_000 + F.col("i")).alias("turn"), "data")
    n = F.octet_length("data") + 7
    head = _x("FFF1", F.unhex(put_be(F.lit(0x50000000).bitwiseOR(F.shiftleft(F.lit(2).cast("long"), 22)).bitwiseOR(F.shiftleft(n.cast("long"), 5)).bitwiseOR(F.lit(0x1F)), 4)), "FC")
    stream = _stream(rows, _x(head, F.col("data")))
    rows = stream.select("conv_id", F.posexplode(sp.adts_frames(F.col("data"))).alias("n", "f"))
    return rows.select("conv_id", "n", "f.profile", "f.rate", "f.channels", F.sha2("f.payload", 256).alias("sha256"))


def mjpeg_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is an image with a small image inside."""
    stream = _stream(turns(spark, sf_dir), _x("FFD8", "FFD80102FFD9", F.col("data"), "FFD9"))
    rows = stream.select("conv_id", F.posexplode(sp.jpeg_images(F.col("data"))).alias("n", "image"))
    return rows.select("conv_id", "n", F.octet_length("image").alias("size"), F.sha2("image", 256).alias("sha256"))


def h264_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RTP payloads: SPS and PPS in a STAP-A before each fifth turn; slices whole, or in FU-A pieces where they are long."""
    first = F.when(F.col("role") == "user", 0x65).otherwise(0x41)
    one = F.array(_x(F.unhex(put_be(first, 1)), F.col("data")))
    parts = chunks(F.col("data"), PIECE)
    mark = lambda i: F.when(i == 0, 0x80).when(i == F.size("parts") - 1, 0x40).otherwise(0)
    rows = turns(spark, sf_dir).withColumn("parts", parts)
    many = F.transform("parts", lambda p, i: _x(F.unhex(put_be(first.bitwiseAND(0xE0) + 28, 1)), F.unhex(put_be(mark(i) + first.bitwiseAND(31), 1)), p))
    heads = F.when(F.col("turn") % 5 == 0, F.array(F.unhex(F.lit("78000467414200000268CE")))).otherwise(F.array().cast("array<binary>"))
    rows = rows.select("conv_id", "turn", F.posexplode(F.concat(heads, F.when(F.size("parts") > 1, many).otherwise(one))).alias("i", "payload"))
    return rows.select("conv_id", (F.col("turn") * 100_000 + F.col("i")).alias("seq"), "payload", F.lit(False).alias("marker"))


def h264_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reassembly.units(h264_packets(spark, sf_dir), "h264", "conv_id", "seq", tail=True)
    return out.select("conv_id", "n", F.octet_length("unit").alias("size"), F.sha2("unit", 256).alias("sha256"))


def h265_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long turns in fragments, the marker on the last packet of each turn."""
    rows = turns(spark, sf_dir).withColumn("parts", chunks(F.col("data"), PIECE))
    last = lambda i: i == F.size("parts") - 1
    many = F.transform("parts", lambda p, i: F.struct(_x("6201", F.unhex(put_be(F.when(i == 0, 0x80).when(last(i), 0x40).otherwise(0) + 1, 1)), p).alias("payload"), last(i).alias("marker")))
    one = F.array(F.struct(_x("0201", F.col("data")).alias("payload"), F.lit(True).alias("marker")))
    rows = rows.select("conv_id", "turn", F.posexplode(F.when(F.size("parts") > 1, many).otherwise(one)).alias("i", "p"))
    packets = rows.select("conv_id", (F.col("turn") * 100_000 + F.col("i")).alias("seq"), "p.payload", "p.marker")
    return reassembly.units(packets, "h265", "conv_id", "seq").select("conv_id", "n", F.octet_length("unit").alias("size"), F.sha2("unit", 256).alias("sha256"))


def jpeg_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("parts", chunks(_x(F.col("data"), "00"), PIECE))
    packets = F.transform("parts", lambda p, i: F.struct(_x("00", F.unhex(put_be(i * PIECE, 3)), "01", "32", "1010", p).alias("payload"), (i == F.size("parts") - 1).alias("marker")))
    return rows.select("conv_id", "turn", F.posexplode(packets).alias("i", "p")).select("conv_id", (F.col("turn") * 100_000 + F.col("i")).alias("seq"), "p.payload", "p.marker")


def jpeg_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassembly.units(jpeg_packets(spark, sf_dir), "jpeg", "conv_id", "seq").select("conv_id", "n", F.octet_length("unit").alias("size"), F.sha2("unit", 256).alias("sha256"))


def jfif_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassembly.units(jpeg_packets(spark, sf_dir), "jfif", "conv_id", "seq").select("conv_id", "n", F.octet_length("unit").alias("size"), F.sha2("unit", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (h264_split, h264_predicates, adts_split, mjpeg_split, h264_units, h265_units, jpeg_scans, jfif_images)}

_T = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS x, strlen(coalesce(text, '')) AS n FROM conversations)"
# The header of an image of 128 by 128 pixels, kind 1, quality 50.
_JFIF = (
    "FFD8" "FFE000104A46494600020100000100010000"
    "FFDB008400" "100B0C0E0C0A100E0D0E1211101318281A181616183123251D283A333D3C3933383740485C4E404457453738506D51575F626768673E4D71797064785C656763"
    "01" "111212181518 2F1A1A2F63423842" + "63" * 50 +
    "FFC401A2" "0000010501010101010100000000000000000102030405060708090A0B" "0100030101010101010101010000000000000102030405060708090A0B"
    "100002010303020403050504040000017D" "01020300041105122131410613516107227114328191A1082342B1C11552D1F02433627282090A161718191A25262728292A3435363738393A434445464748494A535455565758595A636465666768696A737475767778797A"
    "838485868788898A92939495969798999AA2A3A4A5A6A7A8A9AAB2B3B4B5B6B7B8B9BAC2C3C4C5C6C7C8C9CAD2D3D4D5D6D7D8D9DAE1E2E3E4E5E6E7E8E9EAF1F2F3F4F5F6F7F8F9FA"
    "1100020102040403040705040400010277" "000102031104052131061241510761711322328108144291A1B1C109233352F0156272D10A162434E125F11718191A262728292A35363738393A434445464748494A535455565758595A636465666768696A737475767778797A"
    "82838485868788898A92939495969798999AA2A3A4A5A6A7A8A9AAB2B3B4B5B6B7B8B9BAC2C3C4C5C6C7C8C9CAD2D3D4D5D6D7D8D9DAE2E3E4E5E6E7E8E9EAF2F3F4F5F6F7F8F9FA"
    "FFC0001108008000800301220002110103110 1" "FFDA000C03010002110311003F00"
).replace(" ", "")
_N = "CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS n"
ORACLES = {
    "h264_split": f"""WITH {_T}, u AS (SELECT conv_id, turn, 1 AS k, 6::BIGINT AS b, 2 AS nals, 8 AS ty FROM t WHERE turn % 5 = 0 UNION ALL SELECT conv_id, turn, 2, n + 1, 1, CASE WHEN role = 'user' THEN 5 ELSE 1 END FROM t)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS unit, nals, ty AS last_type, true AS complete, b AS n_bytes FROM u""",
    "h264_predicates": f"""WITH {_T}, f AS (SELECT conv_id, arg_min(turn, turn) AS first, arg_min(role, turn) AS role, count(*) + 2 * count(*) FILTER (turn % 5 = 0) AS n_units, min(CASE WHEN turn % 5 = 0 THEN turn END) AS sps FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN first % 5 = 0 THEN 7 WHEN role = 'user' THEN 5 ELSE 1 END AS nal_type, role = 'user' AS "key", first % 5 = 0 AS sequence_header, n_units,
 (SELECT CAST(sum(n + 5 + CASE WHEN turn % 5 = 0 THEN 14 ELSE 0 END) AS BIGINT) FROM t WHERE t.conv_id = f.conv_id AND t.turn >= f.sps) AS from_sps FROM f""",
    "adts_split": f"""WITH {_T}, c AS (SELECT conv_id, turn, i, substring(hex(encode(x)), CAST(i * 16000 + 1 AS BIGINT), 16000) AS h FROM (SELECT *, unnest(range(0, (strlen(x) + 7999) // 8000)) AS i FROM t))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS INTEGER) AS n, 1 AS profile, 4 AS rate, 2 AS channels, sha256(unhex(h)) AS sha256 FROM c""",
    "mjpeg_split": f"WITH {_T} SELECT conv_id, {_N}, n + 10 AS size, sha256(unhex('FFD8FFD80102FFD9' || hex(encode(x)) || 'FFD9')) AS sha256 FROM t".replace("n + 10", "strlen(x) + 10"),
    "h264_units": f"""WITH {_T}, u AS (SELECT conv_id, turn, 1 AS k, '0000000109F0' || '0000000167414200' || '0000000168CE' AS h FROM t WHERE turn % 5 = 0
UNION ALL SELECT conv_id, turn, 2, '0000000109F000000001' || CASE WHEN role = 'user' THEN '65' ELSE '41' END || hex(encode(x)) FROM t UNION ALL SELECT DISTINCT conv_id, -1, 0, '0000000109F0' FROM t)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS INTEGER) AS n, len(h) // 2 AS size, sha256(unhex(h)) AS sha256 FROM u""",
    "h265_units": f"WITH {_T} SELECT conv_id, {_N}, strlen(x) + 6 AS size, sha256(unhex('000000010201' || hex(encode(x)))) AS sha256 FROM t",
    "jfif_images": f"WITH {_T} SELECT conv_id, {_N}, CAST(strlen(x) + 3 + {len(_JFIF) // 2} AS INTEGER) AS size, sha256(unhex('{_JFIF}' || hex(encode(x)) || '00FFD9')) AS sha256 FROM t",
    "jpeg_scans": f"WITH {_T} SELECT conv_id, {_N}, strlen(x) + 1 AS size, sha256(unhex(hex(encode(x)) || '00')) AS sha256 FROM t",
}
