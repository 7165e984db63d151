"""Continuity audit and repair over the packet view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.operators.continuity import repaired_cc, with_discontinuity
from riffle.plans.views import PACKETS_SQL, packets


def cc_discontinuities(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = with_discontinuity(packets(spark, sf_dir))
    return seen.groupBy("pid").agg(
        F.count("*").alias("n_packets"), F.sum(F.col("discontinuous").cast("long")).alias("n_discontinuities"), F.min(F.when(F.col("discontinuous"), F.col("off"))).alias("first_off")
    )


def cc_shift_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).select("pid", "off", "cc", repaired_cc().alias("repaired_cc"))


QUERIES = {"cc_discontinuities": cc_discontinuities, "cc_shift_repair": cc_shift_repair}

ORACLES = {
    "cc_discontinuities": f"""WITH {PACKETS_SQL}, seen AS (
  SELECT pid, off, coalesce(cc <> (lag(cc) OVER (PARTITION BY pid ORDER BY off) + 1) % 16, false) AS bad FROM packets)
SELECT pid, count(*) AS n_packets, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS n_discontinuities, min(CASE WHEN bad THEN off END) AS first_off
FROM seen GROUP BY pid""",
    "cc_shift_repair": f"""WITH {PACKETS_SQL}
SELECT pid, off, cc, (first_value(cc) OVER w + row_number() OVER w - 1) % 16 AS repaired_cc FROM packets WINDOW w AS (PARTITION BY pid ORDER BY off)""",
}
