"""H.264 syntax and AMF0 queries over numbers and attributes of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import amf
from riffle.functions import h264 as h
from riffle.functions import splitting as sp
from riffle.functions.bytesx import bits, chunks
from riffle.session import table


def exp_golomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each order as codes one after another, read back."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    rows = rows.select("l_orderkey", F.size("x").alias("n"), F.array_join(F.transform("x", lambda v: F.concat(h.ue_bits(v["l_partkey"]), h.se_bits(v["l_linenumber"] - 4))), "").alias("bits"))
    rows = rows.select("l_orderkey", F.length("bits").alias("n_bits"), F.posexplode(h.ue_values(F.col("bits"), F.col("n") * 2)).alias("pos", "v"))
    return rows.select("l_orderkey", "n_bits", "pos", F.when(F.col("pos") % 2 == 1, h.signed(F.col("v"))).otherwise(F.col("v")).alias("v"))


def sps_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence parameter set for each part, written as bits and parsed; sizes follow."""
    size, kind = F.col("p_size"), F.col("p_partkey") % 2 * 2
    ue = lambda v: h.ue_bits(v if isinstance(v, F.Column) else F.lit(v))
    whole = F.concat(F.lpad(F.bin(F.lit(66)), 8, "0"), F.lit("00000000"), F.lpad(F.bin(F.lit(30)), 8, "0"), ue(F.col("p_partkey") % 32), ue(4), ue(kind), F.when(kind == 0, ue(2)).otherwise(""), ue(1), F.lit("0"), ue(size + 1), ue(size), F.when(size % 2 == 0, "1").otherwise("01"))
    rows = table(spark, sf_dir, "part").select("p_partkey", whole.alias("bits"))
    rows = rows.select("p_partkey", h.sps_fields(F.col("bits")).alias("sps")).select("p_partkey", "sps.*")
    return rows.select("*", *[c.alias(n) for n, c in h.picture_size(F.col("width_mbs"), F.col("height_units"), F.col("frame_mbs_only")).items()])


def slice_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, n = F.col("p_size") % 7 + 2, F.col("p_size") % 5 + 20
    runs = F.array((F.col("p_partkey") % 3 + 1).cast("long"), (F.col("p_size") % 4 + 1).cast("long"))
    first = F.array(F.col("p_partkey") % 9, F.col("p_size") % 6)  # two rectangles that may overlap
    last = F.array(F.col("p_partkey") % 9 + w + 1, F.col("p_size") % 6 + 2 * w + 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), n.alias("n"), runs.alias("runs"), first.alias("first"), last.alias("last"))
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), "")
    return rows.select("p_partkey", text(h.interleaved_groups(F.col("n"), F.col("runs"))).alias("interleaved"), text(h.dispersed_groups(F.col("n"), F.col("w"), F.lit(3))).alias("dispersed"), text(h.foreground_groups(F.col("n"), F.col("w"), F.col("first"), F.col("last"))).alias("foreground"))


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("kind"), F.col("p_size"))
    found = h.order_count_idr(F.col("kind"), F.col("p_size"), F.col("kind") - 1) | h.coded_block(F.col("p_size") % 48)
    return rows.select("p_partkey", *[c.cast("long").alias(n) for n, c in found.items()], h.clip3(F.lit(5), F.lit(40), F.col("p_size")).cast("long").alias("clipped"))


def binarisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_linenumber").cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"), (F.col("l_partkey") % 61 - 30).cast("long").alias("s"))
    return rows.select("l_orderkey", "l_linenumber", h.unary(F.col("v")).alias("u"), h.truncated_unary(F.col("v"), F.lit(7)).alias("tu"), h.fixed_length(F.col("v"), F.lit(7)).alias("fl"), h.ueg(F.col("s"), 9, 3, True).alias("ueg3"), h.ueg(F.abs("s"), 14, 0, False).alias("ueg0"))


def amf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of each order as an AMF0 object, and a field of it read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.lit("connect").alias("cmd"), F.col("o_totalprice").cast("double").alias("price"), F.struct(F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("even")).alias("info"))).alias("j"))
    o = o.select("o_orderkey", amf.from_json("j").alias("a")).select("o_orderkey", F.octet_length("a").alias("size"), amf.to_json("a").alias("j"))
    v = F.parse_json("j")
    return o.select("o_orderkey", "size", F.try_variant_get(v, "$.cmd", "string").alias("cmd"), F.try_variant_get(v, "$.price", "double").alias("price"), F.try_variant_get(v, "$.info.status", "string").alias("status"), F.try_variant_get(v, "$.info.even", "boolean").alias("even"))


def bit_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of 3, 5, 11 and 13 bits over the whole of each address, four bytes at a time."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(chunks(F.encode("url", "UTF-8"), 4)).alias("n", "word")).where(F.octet_length("word") == 4).select("page_id", "n", bits(F.col("word")).alias("b"))
    at, out = 1, []
    for n in (3, 5, 11, 13):
        out.append(F.conv(F.substring("b", at, n), 2, 10).cast("long").alias(f"f{n}"))
        at += n
    return rows.select("page_id", "n", *out)


def unit_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as payloads, some with a start code or zeros at their end: profiles, what is behind the first eight bytes, and whether data is left at a position."""
    k = F.col("page_id")
    tail = F.unhex(F.element_at(F.array(*map(F.lit, ("", "00000001", "000000", "0001"))), (k % 4 + 1).cast("int")))
    flags = F.unhex(F.concat(*[F.when((F.floor(k / 3) + i // 2) % 2 == 0, "01").otherwise("00") for i in range(16)]))
    profile = F.element_at(F.array(*map(F.lit, (66, 100, 110))), (k % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.encode("url", "UTF-8"), tail).alias("d"), flags.alias("flags"), profile.alias("profile"))
    return rows.select(
        "page_id", F.hex(sp.without_first_eight(F.substring("d", F.lit(1), (k % 12 + 4).cast("int")))).alias("behind"), sp.is_constrained_baseline(F.col("profile"), F.col("flags")).alias("baseline"), sp.is_constrained_high(F.col("profile"), F.col("flags")).alias("high"), sp.is_high_10_intra(F.col("profile"), F.col("flags")).alias("intra"),
        sp.ends_with_start_code(F.col("d")).alias("start"), sp.ends_with_three_zeros(F.col("d")).alias("zeros"), sp.more_data(bits(F.col("d")), k % 8 + (F.octet_length("d") - 2) * 8).alias("more"),
    )


def macroblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, code = F.col("l_partkey") % 30, F.col("l_partkey") % 50
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.element_at(F.array(*map(F.lit, "IPB")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("slice"))
    return rows.select("l_orderkey", "l_linenumber", "slice", h.macroblock_name(F.col("slice"), kind).alias("name"), h.me_value(code, True, True).alias("intra"), h.me_value(code, False, False).alias("inter"), h.context_state(kind - 15, code, F.col("l_linenumber") * 9).cast("long").alias("state"))


QUERIES = {f.__name__: f for f in (exp_golomb, sps_parse, slice_groups, order_counts, binarisations, amf_round_trip, bit_reader, unit_predicates, macroblocks)}

_BITS = "2 * len(bin({v} + 1)) - 1"
_UEG = """CASE WHEN abs({s}) < {c} THEN repeat('1', abs({s})) || '0' ELSE repeat('1', {c}) || repeat('1', st) || '0' || CASE WHEN st + {k} > 0 THEN lpad(bin(abs({s}) - {c} - ((1 << (st + {k})) - (1 << {k}))), CAST(st + {k} AS INTEGER), '0') ELSE '' END END"""
ORACLES = {
    "exp_golomb": f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber - 4 AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem),
n AS (SELECT l_orderkey, CAST(sum({_BITS.format(v='l_partkey')} + {_BITS.format(v='(CASE WHEN s > 0 THEN s * 2 - 1 ELSE -2 * s END)')}) AS BIGINT) AS n_bits FROM r GROUP BY l_orderkey)
SELECT l_orderkey, n_bits, 2 * i AS pos, l_partkey AS v FROM r JOIN n USING (l_orderkey) UNION ALL SELECT l_orderkey, n_bits, 2 * i + 1, s FROM r JOIN n USING (l_orderkey)""",
    "sps_parse": """SELECT p_partkey, 66 AS profile, 30 AS level, p_partkey % 32 AS sps_id, p_partkey % 2 * 2 AS order_count_type, 1::BIGINT AS ref_frames, p_size + 2 AS width_mbs, p_size + 1 AS height_units, p_size % 2 = 0 AS frame_mbs_only,
(p_size + 2) * 16 AS width, (p_size + 1) * CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END * 16 AS height, (p_size + 2) * (p_size + 1) * CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS n_mbs FROM part""",
    "slice_groups": """WITH r AS (SELECT p_partkey, p_size % 7 + 2 AS w, p_size % 5 + 20 AS n, p_partkey % 3 + 1 AS a, p_size % 4 + 1 AS b, p_partkey % 9 AS f0, p_size % 6 AS f1 FROM part),
c AS (SELECT *, f0 + w + 1 AS l0, f1 + 2 * w + 1 AS l1 FROM r)
SELECT p_partkey, array_to_string(list_transform(range(0, n), lambda i: CASE WHEN i % (a + b) < a THEN 0 ELSE 1 END), '') AS interleaved, array_to_string(list_transform(range(0, n), lambda i: (i % w + ((i // w) * 3) // 2) % 3), '') AS dispersed,
array_to_string(list_transform(range(0, n), lambda i: CASE WHEN i % w BETWEEN f0 % w AND l0 % w AND i // w BETWEEN f0 // w AND l0 // w THEN 0 WHEN i % w BETWEEN f1 % w AND l1 % w AND i // w BETWEEN f1 // w AND l1 // w THEN 1 ELSE 2 END), '') AS foreground FROM c""",
    "order_counts": """SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS BIGINT) AS top, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size - 1 ELSE 0 END AS BIGINT) AS bottom,
CAST((p_size % 48) % 16 AS BIGINT) AS luma, CAST((p_size % 48) // 16 AS BIGINT) AS chroma, CAST(greatest(5, least(40, p_size)) AS BIGINT) AS clipped FROM part""",
    "binarisations": f"""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS v, CAST(l_partkey % 61 - 30 AS BIGINT) AS s FROM lineitem),
t AS (SELECT *, CAST(CASE WHEN abs(s) >= 9 THEN floor(log2(((abs(s) - 9) >> 3) + 1)) ELSE 0 END AS BIGINT) AS st3, CAST(CASE WHEN abs(s) >= 14 THEN floor(log2(abs(s) - 14 + 1)) ELSE 0 END AS BIGINT) AS st0 FROM r)
SELECT l_orderkey, l_linenumber, repeat('1', v) || '0' AS u, CASE WHEN v < 7 THEN repeat('1', v) || '0' ELSE repeat('1', v) END AS tu, lpad(bin(v), 3, '0') AS fl,
{_UEG.format(s='s', c=9, k=3).replace(' st', ' st3').replace('(st ', '(st3 ')} || CASE WHEN s > 0 THEN '0' WHEN s < 0 THEN '1' ELSE '' END AS ueg3, {_UEG.format(s='s', c=14, k=0).replace(' st', ' st0').replace('(st ', '(st0 ')} AS ueg0 FROM t""",
    "amf_round_trip": "SELECT o_orderkey, 64 + strlen(o_orderstatus) AS size, 'connect' AS cmd, CAST(o_totalprice AS DOUBLE) AS price, o_orderstatus AS status, o_orderkey % 2 = 0 AS even FROM orders",
    "macroblocks": f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 30 AS k, l_partkey % 50 AS c, ['I', 'P', 'B'][l_orderkey % 3 + 1] AS slice FROM lineitem), i AS (SELECT *, k - CASE slice WHEN 'P' THEN 5 WHEN 'B' THEN 23 ELSE 0 END AS i FROM r)
SELECT l_orderkey, l_linenumber, slice, CASE WHEN slice = 'P' AND k < 5 THEN {list(h.P_TYPES)}[k + 1] WHEN slice = 'B' AND k < 23 THEN {list(h.B_TYPES)}[k + 1] WHEN i = 0 THEN 'I_NxN' WHEN i = 25 THEN 'I_PCM' WHEN i BETWEEN 1 AND 24 THEN 'I_16x16_' || ((i - 1) % 4) || '_' || (((i - 1) // 4) % 3) || '_' || CASE WHEN i > 12 THEN 1 ELSE 0 END END AS name,
{list(h.CBP[True, True])}[c + 1] AS intra, {list(h.CBP[False, False])}[c + 1] AS inter, CAST(greatest(1, least(126, CAST(floor((k - 15) * greatest(0, least(51, l_linenumber * 9)) / 16.0) AS BIGINT) + c)) AS BIGINT) AS state FROM i""",
    "bit_reader": """WITH b AS (SELECT page_id, hex(encode(url)) AS h, unnest(range(0, strlen(url) // 4)) AS n FROM pages), v AS (SELECT page_id, n, ('0x' || substring(h, CAST(n * 8 + 1 AS BIGINT), 8))::BIGINT AS v FROM b)
SELECT page_id, CAST(n AS INTEGER) AS n, v >> 29 AS f3, (v >> 24) & 31 AS f5, (v >> 13) & 2047 AS f11, v & 8191 AS f13 FROM v""",
    "unit_predicates": """WITH r AS (SELECT page_id AS k, hex(encode(url)) || ['', '00000001', '000000', '0001'][page_id % 4 + 1] AS h, [66, 100, 110][page_id % 3 + 1] AS p FROM pages),
b AS (SELECT *, len(h) // 2 AS n, (k % 8) + (len(h) // 2 - 2) * 8 AS pos, rtrim(h, '0') AS t FROM r), l AS (SELECT *, strpos('123456789ABCDEF', right(t, 1)) AS x FROM b)
SELECT k AS page_id, CASE WHEN k % 12 + 4 > 8 THEN substring(h, 17, CAST((k % 12 + 4 - 8) * 2 AS BIGINT)) ELSE substring(h, 1, CAST((k % 12 + 4) * 2 AS BIGINT)) END AS behind, p = 66 AND (k // 3 + 4) % 2 = 0 AS baseline, p = 100 AND (k // 3 + 6) % 2 = 0 AS high,
 p = 110 AND (k // 3 + 5) % 2 = 0 AS intra, k % 4 = 1 AS "start", k % 4 = 2 AS zeros, len(t) * 4 - 1 - CASE WHEN x % 2 = 1 THEN 0 WHEN x % 4 = 2 THEN 1 WHEN x % 8 = 4 THEN 2 ELSE 3 END > pos AS more FROM l""",
}
