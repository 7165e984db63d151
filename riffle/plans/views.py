"""Media views over the supplied tables, which carry no media themselves.

``events`` stand for transport packets, ``documents`` for byte streams, ``embeddings`` for PCM signals and
two users of ``events`` for a pair of cameras. The SQL of each view is ANSI text for the oracle side; the
DataFrame of the same name is what the queries read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.session import table

#: Streams grow with the users; a PID has 13 bits.
PIDS = 8_000
PACKETS_SQL = """
packets AS (
  SELECT pid, off, ts, ts_us, event_type, value, k,
         event_type IN ('signup', 'purchase') AS pusi,
         (ts_us * 9) // 100 AS pts,
         (row_number() OVER w - 1 + sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w) % 16 AS cc
  FROM (SELECT user_id % 8000 AS pid, event_id AS off, ts, epoch_us(ts) AS ts_us, event_type, value,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  WINDOW w AS (PARTITION BY pid ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def raw_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % PIDS).alias("pid"),
        F.col("event_id").alias("off"),
        "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of as many PIDs as there are users; an ``error`` event stands for a lost packet, so the counter skips one there."""
    w = Window.partitionBy("pid").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lost = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w)
    return raw_packets(spark, sf_dir).select(
        "*",
        F.col("event_type").isin("signup", "purchase").alias("pusi"),
        F.expr("(ts_us * 9) div 100").alias("pts"),
        ((F.row_number().over(Window.partitionBy("pid").orderBy("off")) - 1 + lost) % 16).alias("cc"),
    )
