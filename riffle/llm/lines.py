"""Line deduplication across documents.

Lines are split at ``\\n``, normalised (ASCII white space stripped at both ends, A-Z lower-cased) and hashed to 128
bits. Distinct documents are counted for each hash, and where there are ``min_docs`` or more every line of the hash goes,
except in the document with the largest id that holds it. What stays is put together again by position.

Only hashes and positions of lines long enough to count are shuffled. Counting combines before the shuffle,
so a line that a third of the documents hold costs one row for each task.

Defined results: a null or empty text is one empty line; a document whose lines all go has an empty text; rows with a
null id keep all lines and count for none; repeated rows are one document and lose the same lines; ties have one
answer, as only the largest id keeps a line; an empty table gives an empty result. Other columns of the input come
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.llm.simhash import LOWER
from riffle.session import cut, table

SPACE = " \t\n\x0b\x0c\r"
#: Rows that a task gives on at a time.
ROWS = 50_000


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``id, tag, pos, h1, h2`` of each line whose key has ``min_chars`` code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tags, at, h = [], [], [], []

        def flush() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(h), dtype=">i8").astype(np.int64).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(at, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["id", "tag", "pos", "h1", "h2"])
            for x in (ids, tags, at, h):
                x.clear()
            return out

        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for pos, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= min_chars and len(key := line.strip(SPACE)) >= min_chars:
                        ids.append(doc)
                        tags.append(tag)
                        at.append(pos)
                        h.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").translate(LOWER)))
                if len(h) >= ROWS:
                    yield flush()
        yield flush()

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text")
    return rows.mapInArrow(run, "id long, tag long, pos int, h1 long, h2 long")


def drop_positions(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``id, tag, drop``: the positions of the lines that go, for each document that loses any. tag tells rows of one id with different texts apart."""
    lines = cut(line_hashes(docs, min_chars))
    often = lines.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    often = cut(often.select("h1", "h2", "keeper"))  # so that the join below stands alone and a common line's part of it can be split
    gone = lines.join(often, ["h1", "h2"]).where("id != keeper")
    return cut(gone.groupBy("id", "tag").agg(F.collect_set("pos").alias("drop")))  # so that a repeated row's part of the join with texts can be split


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` and, added, ``n_lines`` (before) and ``n_dropped``, in place of columns of these names."""
    gone = drop_positions(docs, min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("row"))  # no other name can clash with the columns of docs
    row, text = F.col("row"), F.coalesce(F.col("row.text"), F.lit(""))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("tag")).join(gone, ["id", "tag"], "left")
    rows = rows.withColumn("lines", F.split(text, "\n"))
    rows = rows.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")))
    kept = F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")
    return rows.select(
        *[(F.when(F.col("drop").isNull(), text).otherwise(kept) if c.lower() == "text" else row.getField(c)).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup}

#: ASCII lower-casing as such: lower() would also fold other letters.
KEY_SQL = r"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op4_line_dedup": f"""WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, pos, lines[pos] AS line, {KEY_SQL.replace("line,", "lines[pos],")} AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM docs)),
often AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, o.keeper IS NOT NULL AND o.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
}
