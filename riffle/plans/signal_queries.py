"""Audio queries over the signal view: each embedding is 64 samples of 16 bits at 8 kHz."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions.bytesx import put_le
from riffle.operators import dsp, sound
from riffle.session import table

RATE = 8000
SIGNAL_SQL = "signal AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(CAST(x AS DOUBLE) * 32767) AS INTEGER)) AS s FROM embeddings)"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") * 32767).cast("int")).alias("s"))


def _rows(df: DataFrame, values, name: str = "v") -> DataFrame:
    return df.select("vec_id", F.posexplode(values).alias("pos", name))


def amplify_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(signal(spark, sf_dir), dsp.amplified(F.col("s"), -3.5))


def pcm_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("vec_id", F.round(F.aggregate(dsp.floats(F.col("s")), F.lit(0.0), lambda a, v: a + v * v), 6).alias("energy"))


def pcm_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(signal(spark, sf_dir), dsp.quantised(dsp.floats(F.col("s"))))


def stereo_to_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(signal(spark, sf_dir), dsp.left_channel(F.col("s")))


def resample_block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(signal(spark, sf_dir), dsp.block_mean(F.col("s"), 6))


def data_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 8000).alias("rate"), (F.col("l_orderkey") % 2 + 1).alias("channels"), (F.col("l_orderkey") % 3 * 8 + 12).alias("depth"), (F.col("l_quantity") / 4).cast("double").alias("seconds"))
    return rows.select("l_orderkey", "l_linenumber", dsp.data_size(F.col("rate"), F.col("channels"), F.col("depth"), F.col("seconds")).alias("n_bytes"))


def _fir(coefficients: list[float]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = signal(spark, sf_dir).select("vec_id", dsp.floats(F.col("s")).alias("x"))
        return _rows(rows, F.transform(dsp.convolved(F.col("x"), coefficients), lambda v: F.round(v, 6)))

    return query


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("vec_id", F.unhex(F.array_join(F.transform("s", lambda v: put_le(v, 2)), "")).alias("pcm"))


def adpcm_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chunk in hex: length, first sample, index, padding flag and nibbles, the earlier one low."""
    return pcm(spark, sf_dir).select("vec_id", F.hex(sound.adpcm_encoded(F.col("pcm"))["data"]).alias("chunk"))


def adpcm_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pcm(spark, sf_dir).select("vec_id", sound.adpcm_encoded(F.col("pcm"))["data"].alias("chunk"))
    return _rows(rows.select("vec_id", sound.adpcm_decoded(F.col("chunk"))["data"].alias("pcm")), sound.pcm_samples(F.col("pcm"))["values"])


def adpcm_enc_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("l_orderkey") * 2 + 4).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dsp.adpcm_bytes(n).alias("n_bytes"))


def wav_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole file in hex: the 44-byte header of 16-bit mono sound, and the samples."""
    body = F.array_join(F.transform("s", lambda v: put_le(v, 2)), "")
    n = F.size("s") * 2
    num = lambda v, k: put_le(F.lit(v) if isinstance(v, int) else v, k)
    head = F.concat(F.hex(F.lit("RIFF")), num(n + 36, 4), F.hex(F.lit("WAVEfmt ")), num(16, 4), num(1, 2), num(1, 2), num(RATE, 4), num(2 * RATE, 4), num(2, 2), num(16, 2), F.hex(F.lit("data")), num(n, 4))
    return signal(spark, sf_dir).select("vec_id", F.concat(head, body).alias("wav"))


TAPS, LOW, HIGH = 8, 900.0, 2100.0
FILTERS = {"fir_lowpass": dsp.lowpass(TAPS, LOW, RATE), "fir_highpass": dsp.highpass(TAPS, LOW, RATE), "fir_bandpass": dsp.bandpass(TAPS, LOW, HIGH, RATE), "fir_bandstop": dsp.bandstop(TAPS, LOW, HIGH, RATE)}
QUERIES = {f.__name__: f for f in (amplify_clip, pcm_floats, pcm_quantise, stereo_to_mono, resample_block_mean, data_size, adpcm_encode, adpcm_decode, adpcm_enc_bytes, wav_file)} | {name: _fir(h) for name, h in FILTERS.items()}

_EACH = "SELECT vec_id, unnest(range(0, len(v))) AS pos, unnest(v) AS v FROM (SELECT vec_id, {v} AS v FROM signal)"
_FLAT = "(0.21557895 - 0.41663158 * cos(2 * pi() * n / 8) + 0.277263158 * cos(4 * pi() * n / 8) - 0.083578947 * cos(6 * pi() * n / 8) + 0.006947368 * cos(8 * pi() * n / 8))"


def _design(name: str, cut: float, high: bool) -> str:
    f = cut / RATE
    middle, sign = (1 - 2 * f, -1) if high else (2 * f, 1)
    return f"{name} AS (SELECT n, CASE WHEN n = 4 THEN {middle} ELSE {sign} * sin(2 * pi() * {f} * (n - 4.0)) / (pi() * (n - 4.0)) END * {_FLAT} AS h FROM range(0, 9) r(n))"


def _fir_sql(designs: str, h: str) -> str:
    return f"""WITH {SIGNAL_SQL}, {designs}, h AS ({h}), x AS (SELECT vec_id, unnest(range(0, len(s))) AS k, unnest(s) / 32768.0 AS x FROM signal)
SELECT vec_id, CAST(k + n AS INTEGER) AS pos, round(sum(x * h), 6) AS v FROM x, h GROUP BY vec_id, k + n"""


_LO, _HI = _design("lo", LOW, False), _design("hi", LOW, True)
# Step sizes, apart from the table of the operator that they check.
_STEPS = "[7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]"
_ADPCM = f"""steps AS (SELECT {_STEPS} AS t), st AS (SELECT vec_id, s, (SELECT arg_min(i, (d, i)) FROM (SELECT unnest(range(0, 89)) AS i, abs(unnest(t) - abs(abs(s[1]) - abs(s[2]) / 2.0)) AS d FROM steps)) AS i0 FROM signal),
enc AS (SELECT vec_id, s, 1 AS i, s[1] AS est, CAST(i0 AS INTEGER) AS idx, 0 AS nib FROM st UNION ALL
 SELECT vec_id, s, i + 1, greatest(-32768, least(32767, est + CASE WHEN nib >= 8 THEN -diff ELSE diff END)), greatest(0, least(88, idx + [-1, -1, -1, -1, 2, 4, 6, 8][nib % 8 + 1])), nib FROM (
  SELECT *, sg * 8 + b2 * 4 + b1 * 2 + CASE WHEN d - b2 * st - b1 * (st // 2) > st // 4 THEN 1 ELSE 0 END AS nib,
    st // 8 + b2 * st + b1 * (st // 2) + CASE WHEN d - b2 * st - b1 * (st // 2) > st // 4 THEN st // 4 ELSE 0 END AS diff FROM (
   SELECT *, CASE WHEN d - b2 * st > st // 2 THEN 1 ELSE 0 END AS b1 FROM (SELECT *, CASE WHEN d > st THEN 1 ELSE 0 END AS b2 FROM (
    SELECT vec_id, s, i, est, idx, CASE WHEN s[i + 1] < est THEN 1 ELSE 0 END AS sg, abs(greatest(-32768, least(32767, s[i + 1] - est))) AS d, {_STEPS}[idx + 1] AS st FROM enc WHERE i < len(s))))))"""
_LE2 = "format('{{:02X}}{{:02X}}', ({v}) & 255, (({v}) >> 8) & 255)"
_HEX16 = _LE2.format(v="CASE WHEN x < 0 THEN x + 65536 ELSE x END")

ORACLES = {
    "amplify_clip": f"WITH {SIGNAL_SQL} {_EACH.format(v='list_transform(s, lambda x: CAST(trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x / 32768.0::DOUBLE * 3.5)) * 32767) AS INTEGER))')}",
    "pcm_floats": f"WITH {SIGNAL_SQL} SELECT vec_id, round(list_sum(list_transform(s, lambda x: x / 32768.0::DOUBLE * (x / 32768.0::DOUBLE))), 6) AS energy FROM signal",
    "pcm_quantise": f"WITH {SIGNAL_SQL} {_EACH.format(v='list_transform(s, lambda x: CAST(trunc(x / 32768.0::DOUBLE * 32767) AS INTEGER))')}",
    "stereo_to_mono": f"WITH {SIGNAL_SQL} SELECT vec_id, unnest(range(0, len(v))) AS pos, unnest(v) AS v FROM (SELECT vec_id, s[1:64:2] AS v FROM signal)",
    "resample_block_mean": f"WITH {SIGNAL_SQL}, x AS (SELECT vec_id, unnest(range(0, len(s))) AS k, unnest(s) AS x, len(s) AS n FROM signal) SELECT vec_id, CAST(k // 6 AS INTEGER) AS pos, CAST(trunc(sum(x) / 6.0) AS INTEGER) AS v FROM x WHERE k // 6 < n // 6 GROUP BY vec_id, k // 6",
    "data_size": "SELECT l_orderkey, l_linenumber, CAST(trunc((l_orderkey % 2 + 1) * (l_linenumber * 8000) * ((l_orderkey % 3 * 8 + 12) // 8) * CAST(l_quantity / 4 AS DOUBLE)) AS BIGINT) AS n_bytes FROM lineitem",
    "fir_lowpass": _fir_sql(_LO, "SELECT * FROM lo"),
    "fir_highpass": _fir_sql(_HI, "SELECT * FROM hi"),
    "fir_bandpass": _fir_sql(f"{_HI}, {_design('lo', HIGH, False)}", "SELECT hi.n + lo.n AS n, sum(hi.h * lo.h) AS h FROM hi, lo GROUP BY hi.n + lo.n"),
    "fir_bandstop": _fir_sql(f"{_LO}, {_design('hi', HIGH, True)}", "SELECT n, lo.h + hi.h AS h FROM lo JOIN hi USING (n)"),
    "adpcm_encode": f"""WITH RECURSIVE {SIGNAL_SQL}, {_ADPCM}, b AS (SELECT vec_id, (i - 2) // 2 AS k, sum(CASE WHEN (i - 2) % 2 = 0 THEN nib ELSE nib * 16 END) AS b FROM enc WHERE i > 1 GROUP BY ALL)
SELECT st.vec_id, format('{{:02X}}000000', (len(s)) // 2 + 8) || (SELECT {_HEX16} FROM (SELECT s[1] AS x)) || format('{{:02X}}', i0) || format('{{:02X}}', (len(s) - 1) % 2)
  || (SELECT string_agg(format('{{:02X}}', CAST(b AS BIGINT)), '' ORDER BY k) FROM b WHERE b.vec_id = st.vec_id) AS chunk FROM st""",
    "adpcm_decode": f"WITH RECURSIVE {SIGNAL_SQL}, {_ADPCM} SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, est AS v FROM enc",
    "adpcm_enc_bytes": "SELECT l_orderkey, l_linenumber, (l_orderkey * 2 + 2) // 4 + 8 + CASE WHEN (l_orderkey * 2 + 4) % 4 = 0 THEN 1 ELSE 0 END AS n_bytes FROM lineitem",
    "wav_file": f"""WITH {SIGNAL_SQL} SELECT vec_id, '52494646' || format('{{:02X}}{{:02X}}0000', (len(s) * 2 + 36) % 256, (len(s) * 2 + 36) // 256) || '57415645666D7420' || '10000000' || '01000100' || '401F0000' || '803E0000' || '02001000' || '64617461'
  || format('{{:02X}}{{:02X}}0000', (len(s) * 2) % 256, (len(s) * 2) // 256) || array_to_string(list_transform(s, lambda x: {_HEX16}), '') AS wav FROM signal""",
}
