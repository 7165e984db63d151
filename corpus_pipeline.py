"""From raw documents to token ids: five stages, each of which works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.llm import bpe, lines, mixing, quality, simhash
from riffle.session import discard, shared_dir, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), 0.3)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in five documents or more stay in one of them; n_chars follows the text."""
    return lines.dedup_lines(docs).select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text``: the token ids of each whole text, and the text that they decode to."""
    return bpe.decode_documents(bpe.encode_documents(docs, bpe._file(), packed=False), bpe._file(), packed=False)


STAGES = [("quality", good_quality), ("line_dedup", without_repeated_lines), ("near_dedup", one_of_each_group), ("mixing", mixed), ("encoding", encoded)]

#: The stages learn, hash and draw at random: no SQL gives the same rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet in the shared folder and read again.

    Only what the last stage wrote stays there.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", []
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        discard(spark, before)
        before = [f"{folder}/{name}"]
    return docs
