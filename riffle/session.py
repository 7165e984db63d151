"""Session helpers shared by every part of the library."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables; the path may be any that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one of ``spark.checkpoint.dir``.

    Only where no folder is configured and everything runs on one machine (tests, a laptop) a temporary one is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[.*)?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="riffle-ck-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, written: list[str] | None = None) -> DataFrame:
    """Like ``cut``, but as a Parquet table in the shared folder, whose true size the planner knows.

    A checkpoint keeps the size that was estimated for it. Joins multiply estimates, so in a loop they grow to numbers
    that take the planner minutes; loops store what they hand on to the next round. The path is added to ``written``, so that
    a loop can ``discard`` what it needs no longer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder, and empties the list."""
    for path in paths:
        of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(of, True)
    paths.clear()
