"""Queries over H.264 units: syntax written from the numbers of the supplied tables, as bytes, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import units
from riffle.functions.bytesx import put_be
from riffle.functions.h264 import se_bits, ue_bits
from riffle.session import table


def payload(*bits: Column | str) -> Column:
    """Bits one after another, the stop bit and zeros up to a whole byte."""
    text = F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits], F.lit("1" + "0" * 7))  # whole bytes of this end at the last of the seven that is needed
    octets = F.transform(F.regexp_extract_all(text, F.lit("[01]{8}"), F.lit(0)), lambda b: put_be(F.conv(b, 2, 10), 1))
    return F.unhex(F.array_join(octets, ""))


def fixed(v: Column, n: int) -> Column:
    return F.lpad(F.bin(v.cast("long")), n, "0")


def h264_pps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    groups = F.when(k % 2 == 1, F.concat(ue_bits(F.lit(1)), ue_bits(F.lit(0)), ue_bits(s), ue_bits(k % 7))).otherwise(ue_bits(F.lit(0)))
    more = F.when(k % 5 == 0, F.concat(F.lit("11"), F.lit("1"), *[se_bits(s - 8 if j == 0 else F.lit(0)) for j in range(16)], F.lit("0000000"), se_bits(k % 9 - 4))).otherwise("")
    data = payload(ue_bits(k % 256), ue_bits(s % 32), "10", groups, ue_bits(k % 4), ue_bits(F.lit(0)), "110", se_bits(s - 26), se_bits(F.lit(0)), se_bits(k % 5 - 2), "101", more)
    names = {"id": "id", "sps_id": "sps", "more_groups": "more_groups", "run_length_less_1[0]": "run0", "run_length_less_1[1]": "run1", "refs0_less_1": "refs0", "weighted_b": "weighted_b", "qp_less_26": "qp", "chroma_offset": "chroma", "redundant_present": "redundant", "scaling[0][0]": "scaling", "second_chroma_offset": "second"}
    return table(spark, sf_dir, "part").select("p_partkey", units.fields_of(data, units.picture_parameters, names).alias("r")).select("p_partkey", "r.*")


def h264_vui(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    aspect = F.when(k % 3 == 0, F.concat(F.lit("111111111"), fixed(c % 65_536, 16), fixed(k % 65_536, 16))).when(k % 3 == 1, "100000001").otherwise("0")
    timing = F.concat(F.lit("1"), fixed(F.lit(1000), 32), fixed(c + 50_000, 32), F.lit("1"))
    decoder = F.when(k % 2 == 0, F.concat(F.lit("1"), ue_bits(F.lit(1)), F.lit("01000110"), *[F.concat(ue_bits(c + i), ue_bits(k % 1000), F.lit("1")) for i in range(2)], F.lit("1011110111" "0110111000"))).otherwise("0")
    data = payload(aspect, "11", "1", "101", "0", "1", "000000010000001000000011", "0", timing, decoder, "0", F.when(k % 2 == 0, "1").otherwise(""), "0", "11", *[ue_bits(c % (3 + i)) for i in range(6)])
    names = {"aspect": "aspect", "sar_width": "sar_width", "sar_height": "sar_height", "format": "format", "matrix": "matrix", "units_in_tick": "tick", "time_scale": "scale", "nal_hrd.rate_less_1[1]": "rate1", "nal_hrd.size_less_1[0]": "size0", "nal_hrd.output_delay_bits_less_1": "output_bits", "low_delay": "low_delay", "buffered_frames": "buffered"}
    return table(spark, sf_dir, "orders").select("o_orderkey", units.fields_of(data, units.usability, names).alias("r")).select("o_orderkey", "r.*")


def h264_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice headers of all kinds; every eleventh ends early."""
    k, part, kind = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber") % 5
    of = lambda *kinds: kind.isin(*kinds)
    when = lambda cond, *bits: F.when(cond, F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])).otherwise("")
    data = payload(
        ue_bits(part % 400), ue_bits(F.col("l_linenumber") % 10), ue_bits(F.lit(3)), fixed(k % 16, 4), when(of(2), ue_bits(k % 9)), fixed(part % 64, 6), when(of(1), "1"), when(of(0, 3), "1", ue_bits(k % 3)), when(of(1), "0"),
        when(of(0, 3), "1", ue_bits(F.lit(0)), ue_bits(k % 5), ue_bits(F.lit(3))), when(of(1), "00"), when(of(2), "01"), when(~of(2), "1", ue_bits(F.lit(1)), ue_bits(part % 6), ue_bits(F.lit(0))), se_bits(part % 21 - 10), when(of(3), "1"), when(of(3, 4), se_bits(k % 7 - 3)),
    )
    data = F.substring(data, F.lit(1), F.when(part % 11 == 0, 1).otherwise(1 << 20))
    numbers = {"frame_num_bits": F.lit(4), "frames_only": F.lit(1), "order_bits": F.lit(6), "nal_ref": F.lit(1), "nal_type": F.when(of(2), 5).otherwise(1)}
    context = F.create_map(*[x for n, v in numbers.items() for x in (F.lit(n), v.cast("long"))])
    names = {"first_mb": "first_mb", "slice_type": "slice_type", "frame_num": "frame_num", "idr_id": "idr_id", "order_lsb": "lsb", "refs0_less_1": "refs0", "modification_value0[0]": "modified", "difference[0]": "difference", "long_term": "long_term", "qp_delta": "qp", "qs_delta": "qs"}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", units.fields_of(data, units.slice_header, names, context).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.when(F.col("r.err").isNull(), F.col(f"r.{a}")).alias(a) for a in names.values()], "r.err")


def nal_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same three bytes as extension of each of the three kinds."""
    data = F.unhex(put_be(F.col("o_orderkey") * 7_919 + F.col("o_custkey") * 131, 3))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", units.parsed(data, units.mvc_extension)["fields"].alias("m"), units.parsed(data, units.svc_extension)["fields"].alias("s"), units.parsed(data, units.depth_extension)["fields"].alias("d"))
    return rows.select("o_orderkey", *[F.col("m")[n].alias(f"m_{n}") for n in ("priority", "view", "temporal")], *[F.col("s")[n].alias(f"s_{n}") for n in ("dependency", "quality", "reserved")], *[F.col("d")[n].alias(f"d_{n}") for n in ("view_index", "temporal")])


QUERIES = {f.__name__: f for f in (h264_pps, h264_vui, h264_slices, nal_extensions)}

ORACLES = {
    "h264_pps": """SELECT p_partkey, p_partkey % 256 AS id, p_size % 32 AS sps, p_partkey % 2 AS more_groups, CASE WHEN p_partkey % 2 = 1 THEN p_size END AS run0, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 7 END AS run1, p_partkey % 4 AS refs0, 2 AS weighted_b, p_size - 26 AS qp, p_partkey % 5 - 2 AS chroma, 1 AS redundant,
 CASE WHEN p_partkey % 5 = 0 THEN p_size - 8 END AS scaling, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 9 - 4 END AS second, 15 + CASE WHEN p_partkey % 2 = 1 THEN 3 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 11 + CASE WHEN p_size = 0 THEN 1 ELSE 16 END ELSE 0 END AS n_fields, CAST(NULL AS VARCHAR) AS err FROM part""",
    "h264_vui": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 255 WHEN 1 THEN 1 END AS aspect, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 65536 END AS sar_width, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 65536 END AS sar_height, 5 AS format, 3 AS matrix, 1000 AS tick, o_custkey + 50000 AS scale,
 CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 END AS rate1, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 1000 END AS size0, CASE WHEN o_orderkey % 2 = 0 THEN 13 END AS output_bits, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS low_delay, o_custkey % 8 AS buffered,
 26 + CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 14 ELSE 0 END AS n_fields, CAST(NULL AS VARCHAR) AS err FROM orders""",
    "h264_slices": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 5 AS t, l_partkey % 11 <> 0 AS ok FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ok THEN l_partkey % 400 END AS first_mb, CASE WHEN ok THEN l_linenumber % 10 END AS slice_type, CASE WHEN ok THEN l_orderkey % 16 END AS frame_num, CASE WHEN ok AND t = 2 THEN l_orderkey % 9 END AS idr_id, CASE WHEN ok THEN l_partkey % 64 END AS lsb,
 CASE WHEN ok AND t IN (0, 3) THEN l_orderkey % 3 END AS refs0, CASE WHEN ok AND t IN (0, 3) THEN l_orderkey % 5 END AS modified, CASE WHEN ok AND t <> 2 THEN l_partkey % 6 END AS difference, CASE WHEN ok AND t = 2 THEN 1 END AS long_term, CASE WHEN ok THEN l_partkey % 21 - 10 END AS qp, CASE WHEN ok AND t IN (3, 4) THEN l_orderkey % 7 - 3 END AS qs,
 CASE WHEN NOT ok THEN 'ended early' END AS err FROM r""",
    "nal_extensions": """WITH r AS (SELECT o_orderkey, (o_orderkey * 7919 + o_custkey * 131) & 16777215 AS v FROM orders)
SELECT o_orderkey, (v >> 17) & 63 AS m_priority, (v >> 7) & 1023 AS m_view, (v >> 4) & 7 AS m_temporal, (v >> 13) & 7 AS s_dependency, (v >> 9) & 15 AS s_quality, (v >> 1) & 3 AS s_reserved, (v >> 16) & 255 AS d_view_index, (v >> 11) & 7 AS d_temporal FROM r""",
}
