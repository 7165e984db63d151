"""Coded residuals of H.264 and what decoding them needs, written from numbers of the supplied tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import cabac, cavlc, units
from riffle.functions import h264 as h
from riffle.plans.unit_queries import fixed, payload
from riffle.session import table


def cavlc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block for each line item, of all six classes of tokens, with levels up to escapes; every thirteenth ends early."""
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    nc = F.element_at(F.array(*map(F.lit, (0, 3, 5, 9, -1, -2))), (k + F.col("l_linenumber")).cast("int") % 6 + 1)
    most = F.when(nc == -1, 4).when(nc == -2, 8).otherwise(16)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", nc.alias("nc"), (p % (most + 1)).cast("int").alias("total"))
    rows = rows.withColumn("ones", F.least(F.lit(3), F.col("total"), (s % 4).cast("int")))
    ones, total = F.col("ones"), F.col("total")
    sign = lambda j: F.when(F.floor(s / F.pow(F.lit(2.0), j + 2)) % 2 == 1, -1).otherwise(1)
    size = lambda j: ((k + 7 * j) % 40 + 2) * F.when(k % 5 == 0, 36).otherwise(1) * F.when(j % 2 == 1, -1).otherwise(1)
    levels = F.filter(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.when(j < ones, sign(j)).when(j < total, size(j)).cast("int")), lambda v: v.isNotNull())
    data = cavlc.written(F.col("nc"), ones, F.col("levels"))
    short = F.when((p % 13 == 0) & (total >= 5), 1).otherwise(1 << 20)  # five coefficients take more than a byte
    rows = rows.withColumn("levels", levels).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cavlc.residual(F.substring(data, F.lit(1), short), F.col("nc")).alias("r"))
    text = F.array_join(F.transform("r.levels", lambda v: v.cast("string")), " ")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r.ones", "r.total", text.alias("levels"), "r.err")


def range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part numbers of each order as bins, every seventh without a context, coded and decoded."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    text = F.array_join(F.transform("x", lambda v: F.lpad(F.bin(v["l_partkey"] % 65_536), 16, "0")), "")
    rows = rows.select("l_orderkey", F.transform(F.regexp_extract_all(text, F.lit("[01]"), F.lit(0)), lambda b: b.cast("int")).alias("bins"))
    contexts = F.transform("bins", lambda _, i: F.when(i % 7 == 6, cabac.BYPASS).otherwise(i % 4))
    states = F.array(*[h.context_state(F.col("l_orderkey") % 40 - 20, F.lit(30 + 20 * i), F.col("l_orderkey") % 52).cast("int") for i in range(4)])
    rows = rows.withColumn("ctx", contexts).withColumn("pre", states)
    rows = rows.select("l_orderkey", "ctx", "pre", cabac.encoded_bins(F.col("bins"), F.col("ctx"), F.col("pre")).alias("code"))
    rows = rows.select("l_orderkey", cabac.decoded_bins(F.col("code"), F.concat("ctx", F.array(F.lit(cabac.TERMINATE))), F.col("pre")).alias("r"))
    return rows.select("l_orderkey", F.array_join(F.transform("r.bins", lambda b: b.cast("string")), "").alias("bins"), "r.err")


def context_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starting states for each line item, with m and n from a table of contexts that the parts make up."""
    k = F.col("p_partkey")
    numbers = table(spark, sf_dir, "part").select((k % 1024).alias("ctx"), (F.floor(k / 1024) % 4).alias("kind"), (F.col("p_size") - 25).alias("m"), (k % 128 - 20).alias("n"))
    numbers = numbers.groupBy("ctx", "kind").agg(F.min("m").alias("m"), F.max("n").alias("n"))
    slices = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 1024).cast("int").alias("ctx"), (F.col("l_linenumber") % 4).cast("int").alias("kind"), (F.col("l_suppkey") % 60 - 4).alias("qp"))
    return cabac.context_init(slices, numbers).select("l_orderkey", "l_linenumber", "l_partkey", "pre", "state", "mps")


def range_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range table, with states and quarters that are out of bounds."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cabac.range_of_less(F.col("l_partkey") % 67 - 1, F.col("l_orderkey") % 5).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "r.range", "r.err")


def sps_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence parameters of three profiles and order count types, cropped, with usability information."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    ue = lambda v: h.ue_bits(v if isinstance(v, F.Column) else F.lit(v))
    se = lambda v: h.se_bits(v if isinstance(v, F.Column) else F.lit(v))
    when = lambda cond, *bits: F.when(cond, F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])).otherwise("")
    profile = F.element_at(F.array(*map(F.lit, (66, 100, 244))), (k % 3 + 1).cast("int"))
    lists = [F.concat(F.lit("1"), se(s - 8), se(-s)) if i == 2 else F.lit("0") for i in range(8)]
    data = payload(
        fixed(profile, 8), fixed(k % 4, 8), fixed(s, 8), ue(k % 32), when(k % 3 == 1, ue(1)), when(k % 3 == 2, ue(3), "0"), when(k % 3 > 0, ue(s % 7), ue(k % 5), "0", "1", *lists), when(k % 3 == 2, "0000"),
        ue(s % 10), ue(k % 4 % 3), when(k % 4 % 3 == 0, ue(s % 9)), when(k % 4 % 3 == 1, "0", se(s - 20), se(k % 11 - 5), ue(2), se(s), se(-s)), ue(k % 16), "0", ue(s + 3), ue(s + 1), F.when(s % 2 == 0, "1").otherwise("01"), "1",
        "1", ue(0), ue(k % 8), ue(0), ue(s % 8), "1", "0", "0", "0", "0", "1", fixed(F.lit(1000), 32), fixed(s + 50_000, 32), "1", "0", "0", "0", "0",
    )
    names = {"profile": "profile", "level": "level", "id": "id", "chroma_format": "chroma", "luma_depth_less_8": "luma_depth", "scaling[2][0]": "scaling", "scaling[2][1]": "scaling_end", "order_count_type": "order_type", "order_bits_less_4": "order_bits", "offset_not_reference": "offset", "offset_reference[1]": "offset1", "ref_frames": "refs", "width_less_1": "width", "height_less_1": "height", "frames_only": "frames_only", "crop_right": "crop_right", "crop_bottom": "crop_bottom", "time_scale": "time_scale"}
    return table(spark, sf_dir, "part").select("p_partkey", units.fields_of(data, units.sequence_parameters, names).alias("r")).select("p_partkey", *[f"r.{a}" for a in names.values()], "r.err")


def prediction_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    slice_type = F.element_at(F.array(*map(F.lit, ("I", "SI", "P", "SP", "B", "X"))), (F.col("l_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", h.prediction_mode(slice_type, F.col("l_partkey") % 27, F.col("l_suppkey") % 2 == 1, F.when(F.col("l_partkey") % 17 == 0, 1).otherwise(0)).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "r.mode", "r.err")


def layer_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of samples in the macroblocks of a reference layer."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[c.cast("long").alias(n) for n, c in h.chroma_size(k % 4, p % 5 == 0).items()])
    size = F.when(p % 3 == 0, F.lit(16)).otherwise(F.greatest(F.lit(8), F.col("chroma_width")))
    rows = rows.withColumn("size", size).withColumn("offset", h.layer_offset(k * 37 - p, F.col("size"))).withColumn("place", h.layer_place(F.col("l_linenumber") * 5, F.col("offset"), F.col("size")))
    rows = rows.withColumn("distance", h.layer_distance(F.col("place"), F.col("size")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "chroma_width", "chroma_height", *[F.col(c).cast("long").alias(c) for c in ("offset", "place", "distance")], h.layer_neighbour(F.col("distance"), F.col("size"), p % 3 - 1).cast("long").alias("neighbour"))


QUERIES = {f.__name__: f for f in (cavlc_tokens, range_coder, context_init, range_lookups, sps_profiles, prediction_modes, layer_geometry)}

ORACLES = {
    "cavlc_tokens": """WITH r AS (SELECT l_orderkey AS k, l_linenumber, l_partkey AS p, l_suppkey AS s, [16, 16, 16, 16, 4, 8][(l_orderkey + l_linenumber) % 6 + 1] AS most FROM lineitem),
t AS (SELECT *, p % (most + 1) AS total FROM r), o AS (SELECT *, least(3, total, s % 4) AS ones FROM t),
l AS (SELECT *, list_transform(range(0, total), lambda j: CASE WHEN j < ones THEN 1 - 2 * ((s >> (j + 2)) & 1) ELSE ((k + 7 * j) % 40 + 2) * CASE WHEN k % 5 = 0 THEN 36 ELSE 1 END * CASE WHEN j % 2 = 1 THEN -1 ELSE 1 END END) AS levels FROM o),
e AS (SELECT *, p % 13 <> 0 OR total < 5 AS ok FROM l)
SELECT k AS l_orderkey, l_linenumber, p AS l_partkey, s AS l_suppkey, CASE WHEN ok THEN CAST(ones AS INTEGER) END AS ones, CASE WHEN ok THEN CAST(total AS INTEGER) END AS total, CASE WHEN ok THEN array_to_string(levels, ' ') ELSE '' END AS levels, CASE WHEN NOT ok THEN 'ended early' END AS err FROM e""",
    "range_coder": """SELECT l_orderkey, string_agg(lpad(bin(l_partkey % 65536), 16, '0'), '' ORDER BY l_linenumber, l_partkey) || '1' AS bins, CAST(NULL AS VARCHAR) AS err FROM lineitem GROUP BY l_orderkey""",
    "context_init": """WITH t AS (SELECT p_partkey % 1024 AS ctx, (p_partkey // 1024) % 4 AS kind, min(p_size - 25) AS m, max(p_partkey % 128 - 20) AS n FROM part GROUP BY ALL),
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 1024 AS ctx, l_linenumber % 4 AS kind, l_suppkey % 60 - 4 AS qp FROM lineitem),
j AS (SELECT *, CASE WHEN m IS NOT NULL THEN CAST(greatest(1, least(126, floor(m * greatest(0, least(51, qp)) / 16.0) + n)) AS INTEGER) END AS pre FROM s LEFT JOIN t USING (ctx, kind))
SELECT l_orderkey, l_linenumber, l_partkey, pre, CAST(CASE WHEN pre <= 63 THEN 63 - pre ELSE pre - 64 END AS INTEGER) AS state, CAST(CASE WHEN pre <= 63 THEN 0 WHEN pre > 63 THEN 1 END AS INTEGER) AS mps FROM j""",
    "range_lookups": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 67 - 1 AS s, l_orderkey % 5 AS q FROM lineitem),
e AS (SELECT *, CASE WHEN s < 0 OR s > 63 THEN 'invalid state' WHEN q > 3 THEN 'invalid quarter' END AS err FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN err IS NULL THEN CAST(CASE WHEN s = 63 THEN 2 ELSE greatest(6, least(CASE WHEN q = 0 THEN 128 ELSE 999 END, round(0.5 * pow(0.0375, s / 63.0) * (286.9 + 64.13 * q)))) END AS INTEGER) END AS range, err FROM e""",
    "sps_profiles": """WITH r AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 3 AS f, p_partkey % 4 % 3 AS o FROM part)
SELECT k AS p_partkey, [66, 100, 244][f + 1]::BIGINT AS profile, s::BIGINT AS level, k % 32 AS id, CASE f WHEN 1 THEN 1 WHEN 2 THEN 3 END::BIGINT AS chroma, CASE WHEN f > 0 THEN s % 7 END::BIGINT AS luma_depth, CASE WHEN f > 0 THEN s - 8 END::BIGINT AS scaling, CASE WHEN f > 0 AND s > 0 THEN -s END::BIGINT AS scaling_end,
 o AS order_type, CASE WHEN o = 0 THEN s % 9 END::BIGINT AS order_bits, CASE WHEN o = 1 THEN s - 20 END::BIGINT AS "offset", CASE WHEN o = 1 THEN -s END::BIGINT AS offset1, k % 16 AS refs, (s + 3)::BIGINT AS width, (s + 1)::BIGINT AS height, (1 - s % 2)::BIGINT AS frames_only, k % 8 AS crop_right, (s % 8)::BIGINT AS crop_bottom, (s + 50000)::BIGINT AS time_scale, CAST(NULL AS VARCHAR) AS err FROM r""",
    "prediction_modes": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, ['I', 'SI', 'P', 'SP', 'B', 'X'][l_orderkey % 6 + 1] AS t, l_partkey % 27 AS k, l_suppkey % 2 = 1 AS large FROM lineitem),
m AS (SELECT *, CASE t WHEN 'I' THEN CASE WHEN k = 0 AND large THEN 'Intra_8x8' WHEN k = 0 THEN 'Intra_4x4' WHEN k < 25 THEN 'Intra_16x16' END WHEN 'SI' THEN CASE WHEN k = 0 THEN 'Intra_4x4' END WHEN 'P' THEN CASE WHEN k NOT IN (3, 4) THEN 'Pred_L0' END WHEN 'SP' THEN CASE WHEN k NOT IN (3, 4) THEN 'Pred_L0' END
 WHEN 'B' THEN CASE WHEN k IN (1, 4, 5, 8, 9, 12, 13) THEN 'Pred_L0' WHEN k IN (2, 6, 7, 10, 11, 14, 15) THEN 'Pred_L1' WHEN k = 3 OR k BETWEEN 16 AND 21 THEN 'BiPred' WHEN k <> 22 THEN 'Direct' END END AS mode FROM r),
e AS (SELECT *, CASE WHEN l_partkey % 17 = 0 THEN 'not the first partition' WHEN t = 'X' THEN 'unknown slice type' WHEN mode IS NULL THEN 'no mode for this type' END AS err FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN err IS NULL THEN mode END AS mode, err FROM e""",
    "layer_geometry": """WITH r AS (SELECT l_orderkey AS k, l_linenumber, l_partkey AS p, CASE WHEN l_orderkey % 4 = 0 OR l_partkey % 5 = 0 THEN 0 WHEN l_orderkey % 4 = 3 THEN 16 ELSE 8 END AS cw, CASE WHEN l_orderkey % 4 = 0 OR l_partkey % 5 = 0 THEN 0 WHEN l_orderkey % 4 = 1 THEN 8 ELSE 16 END AS ch FROM lineitem),
s AS (SELECT *, CASE WHEN p % 3 = 0 THEN 16 ELSE greatest(8, cw) END AS size FROM r), o AS (SELECT *, CAST(floor((k * 37 - p - 64) / 256.0) AS BIGINT) * 16 - size // 2 AS o FROM s),
x AS (SELECT *, (l_linenumber * 5 + o) % size AS place FROM o), d AS (SELECT *, CASE WHEN place >= size // 2 THEN place - size ELSE place + 1 END AS d FROM x)
SELECT k AS l_orderkey, l_linenumber, p AS l_partkey, cw::BIGINT AS chroma_width, ch::BIGINT AS chroma_height, o AS "offset", place::BIGINT AS place, d::BIGINT AS distance, (d - (size // 2 + 1) * (p % 3 - 1))::BIGINT AS neighbour FROM d""",
}
