"""Queries over sound as bytes: the signals of the embeddings, and whole texts taken as 16-bit PCM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.operators import sound
from riffle.plans.packet_queries import media
from riffle.plans.signal_queries import _STEPS, SIGNAL_SQL, pcm
from riffle.session import table


def signal_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal in two pieces of sound, of 40 and of 24 samples."""
    return pcm(spark, sf_dir).select("vec_id", F.substring("pcm", 1, 80).alias("a"), F.substring("pcm", 81, 2**31 - 1).alias("b"))


def adpcm_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunks of each signal, one after another, decoded in one go."""
    rows = signal_bytes(spark, sf_dir).select("vec_id", F.concat(sound.adpcm_encoded(F.col("a"))["data"], sound.adpcm_encoded(F.col("b"))["data"]).alias("chunks"))
    out = rows.select("vec_id", "chunks", sound.adpcm_decoded(F.col("chunks")).alias("r"))
    return out.select("vec_id", F.octet_length("chunks").alias("n_bytes"), F.hex("r.data").alias("pcm"))


def pcm_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as 16-bit sound, to numbers and back; empty texts and odd lengths are errors."""
    rows = media(spark, sf_dir).select("doc_id", sound.pcm_floats(F.col("data")).alias("f"))
    rows = rows.select("doc_id", "f.err", sound.pcm_bytes(F.col("f.values")).alias("r"))
    return rows.select("doc_id", "err", F.sha2("r.data", 256).alias("sha256"))


def resample_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as stereo sound: the mean of each six frames, and the left channel."""
    rows = media(spark, sf_dir).select("doc_id", sound.resampled(F.col("data"), 2, 6).alias("r"), sound.mono(F.col("data")).alias("m"))
    return rows.select("doc_id", "r.err", F.sha2("r.data", 256).alias("resampled"), F.sha2("m.data", 256).alias("mono"))


def wav_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAVE files of many formats, some of which are none."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 3).alias("form"), (F.col("l_partkey") % 4).alias("channels"), (F.col("l_suppkey") % 5 * 8000).alias("rate"), (F.col("l_linenumber") % 4 * 8).alias("depth"), F.encode(F.concat_ws("-", "l_orderkey", "l_partkey"), "UTF-8").alias("data"))
    rows = rows.withColumn("w", sound.wave(F.col("data"), F.col("form"), F.col("channels"), F.col("rate"), F.col("depth")))
    return rows.select("l_orderkey", "l_linenumber", "w.err", F.hex("w.data").alias("wav"))


QUERIES = {f.__name__: f for f in (adpcm_chunks, pcm_bytes, resample_bytes, wav_errors)}

_HALVES = f"{SIGNAL_SQL.replace('signal AS', 'whole AS')}, signal AS (SELECT vec_id * 2 AS k, s[1:40] AS s FROM whole UNION ALL SELECT vec_id * 2 + 1, s[41:64] FROM whole)"
_ENC = f"""st AS (SELECT k, s, (SELECT arg_min(i, (d, i)) FROM (SELECT unnest(range(0, 89)) AS i, abs(unnest({_STEPS}) - abs(abs(s[1]) - abs(s[2]) / 2.0)) AS d)) AS i0 FROM signal),
enc AS (SELECT k, s, 1 AS i, s[1] AS est, CAST(i0 AS INTEGER) AS idx FROM st UNION ALL
 SELECT k, s, i + 1, greatest(-32768, least(32767, est + CASE WHEN nib >= 8 THEN -diff ELSE diff END)), greatest(0, least(88, idx + [-1, -1, -1, -1, 2, 4, 6, 8][nib % 8 + 1])) FROM (
  SELECT *, sg * 8 + b2 * 4 + b1 * 2 + CASE WHEN d - b2 * st - b1 * (st // 2) > st // 4 THEN 1 ELSE 0 END AS nib,
    least(32767, st // 8 + b2 * st + b1 * (st // 2) + CASE WHEN d - b2 * st - b1 * (st // 2) > st // 4 THEN st // 4 ELSE 0 END) AS diff FROM (
   SELECT *, CASE WHEN d - b2 * st > st // 2 THEN 1 ELSE 0 END AS b1 FROM (SELECT *, CASE WHEN d > st THEN 1 ELSE 0 END AS b2 FROM (
    SELECT k, s, i, est, idx, CASE WHEN s[i + 1] < est THEN 1 ELSE 0 END AS sg, abs(greatest(-32768, least(32767, s[i + 1] - est))) AS d, {_STEPS}[idx + 1] AS st FROM enc WHERE i < len(s))))))"""
_LE2 = "printf('%02X%02X', ({v}) & 255, (({v}) >> 8) & 255)"
_WORDS = "hx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)"
_PROBLEM = "CASE WHEN h = '' THEN 'no audio data' WHEN len(h) % 4 <> 0 THEN 'uneven number of bytes'"
_SAMPLES = """w AS (SELECT doc_id, i, CAST('0x' || substring(h, i * 4 + 3, 2) || substring(h, i * 4 + 1, 2) AS BIGINT) AS u, n FROM (SELECT doc_id, h, len(h) // 4 AS n, unnest(range(0, len(h) // 4)) AS i FROM hx {where})),
x AS (SELECT doc_id, i, n, CASE WHEN u >= 32768 THEN u - 65536 ELSE u END AS x FROM w)"""
_TWO = "CASE WHEN {v} < 0 THEN {v} + 65536 ELSE {v} END"

ORACLES = {
    "adpcm_chunks": f"""WITH RECURSIVE {_HALVES}, {_ENC}
SELECT k // 2 AS vec_id, 8 + 20 + 8 + 12 AS n_bytes, string_agg({_LE2.format(v=_TWO.format(v="est"))}, '' ORDER BY k, i) AS pcm FROM enc GROUP BY k // 2""",
    "pcm_bytes": f"""WITH {_WORDS}, {_SAMPLES.format(where="WHERE len(h) % 4 = 0")}, y AS (SELECT doc_id, i, CAST(trunc(x / 32768.0::DOUBLE * 32767) AS BIGINT) AS y FROM x),
z AS (SELECT doc_id, sha256(unhex(string_agg({_LE2.format(v=_TWO.format(v="y"))}, '' ORDER BY i))) AS sha256 FROM y GROUP BY doc_id)
SELECT doc_id, {_PROBLEM} END AS err, sha256 FROM hx LEFT JOIN z USING (doc_id)""",
    "resample_bytes": f"""WITH {_WORDS}, {_SAMPLES.format(where="WHERE len(h) % 8 = 0")},
m AS (SELECT doc_id, i // 12 AS g, i % 2 AS c, CAST(trunc(sum(x) / 6.0::DOUBLE) AS BIGINT) AS y FROM x WHERE i // 12 < n // 12 GROUP BY ALL),
r AS (SELECT doc_id, sha256(unhex(string_agg({_LE2.format(v=_TWO.format(v="y"))}, '' ORDER BY g, c))) AS resampled FROM m GROUP BY doc_id),
o AS (SELECT doc_id, sha256(unhex(string_agg({_LE2.format(v=_TWO.format(v="x"))}, '' ORDER BY i))) AS mono FROM x WHERE i % 2 = 0 GROUP BY doc_id)
SELECT doc_id, {_PROBLEM} WHEN len(h) % 8 <> 0 THEN 'last frame is not whole' END AS err, CASE WHEN h <> '' AND len(h) % 8 = 0 THEN coalesce(resampled, sha256('')) END AS resampled, mono FROM hx LEFT JOIN r USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "wav_errors": f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey % 3 AS form, l_partkey % 4 AS channels, l_suppkey % 5 * 8000 AS rate, l_linenumber % 4 * 8 AS depth, hex(encode(l_orderkey || '-' || l_partkey)) AS h FROM lineitem),
e AS (SELECT *, CASE WHEN form <> 1 THEN 'invalid audio format' WHEN channels = 0 THEN 'invalid number of channels' WHEN rate = 0 THEN 'invalid sample rate' WHEN depth = 0 THEN 'invalid bit depth' END AS err,
  len(h) // 2 AS n, rate * channels * depth // 8 AS br FROM r)
SELECT l_orderkey, l_linenumber, err, CASE WHEN err IS NULL THEN '52494646' || {_LE2.format(v="n + 36")} || '000057415645666D7420' || '100000000100' || {_LE2.format(v="channels")} || {_LE2.format(v="rate")} || '0000'
  || {_LE2.format(v="br")} || {_LE2.format(v="br >> 16")} || {_LE2.format(v="channels * depth // 8")} || {_LE2.format(v="depth")} || '64617461' || {_LE2.format(v="n")} || '0000' || h END AS wav FROM e""",
}
