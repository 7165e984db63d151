"""Exact top-k search by inner product in norm buckets.

Vectors are ordered by length and cut into buckets. In a bucket with longest vector l, a candidate that reaches the score
s of a query q needs a cosine of s / (|q| l) at least: the local threshold. Above 1 the bucket is passed over. Where the
threshold leaves few candidates in the shortest feasible range of some coordinates (a pair of cosine t has angles to each
axis that differ by arccos t at most), the bucket's sorted coordinate lists give the candidates and the rest of their
length bounds them once more; elsewhere the prefix of vectors that are long enough is taken. What is left is verified by exact integer
products. Every bound only passes over candidates that are strictly worse than the score already reached, so the result
is exact.

The score to reach starts from the longest ``SEED`` vectors, a bounded set that goes to all tasks. Queries are grouped by
what length they need, and a group meets only shards of buckets that are long enough; shards and groups are matched by
at most ``LEVELS`` levels of length. A task holds one shard of buckets and one group of queries.

Defined results: vectors that are null, hold null or non-finite components, or have another length than most take no
part, nor do rows with a null id; zero vectors take part; components count as floor(256 x), and beyond ``limit`` as the
limit, so that scores fit 64 bits; ties go to the smaller id; repeated rows (same id and vector) are one row; several
vectors under one id are rows of their own, each a candidate (also of the others) and each a query; with fewer candidates
than asked for, the others are missing; empty tables give an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.session import cut, table

#: Longest vectors from which the scores to reach start, and levels of length at most.
SEED, LEVELS = 2_048, 64
#: Vectors of one bucket, buckets of one shard, queries of one group, and queries multiplied at a time.
BUCKET, SHARD, GROUP, TOGETHER = 8_192, 2, 4_096, 256
#: Coordinates looked at, the share of a bucket below which their lists are used, and the local threshold from which on they are looked up.
FOCUS, SHARE, NARROW = 4, 1 / 16, 0.5
#: No score yet.
NONE = -(1 << 63)


def limit(dim: int) -> int:
    """Largest size of a component with which all scores fit 64 bits; at most 2^30."""
    return min(1 << 30, math.isqrt((1 << 62) // max(dim, 1)))


def usable(rows: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``row, vec_id, x, length``: the distinct rows that take part, as integers, numbered."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    found = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    found = cut(found.dropDuplicates(["vec_id", "v"]))
    lengths = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths.n if lengths else 1
    top = float(limit(dim))
    x = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), c * scale))).cast("int"))
    found = found.where(F.size("v") == dim).select(F.monotonically_increasing_id().alias("row"), "vec_id", x.alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    return found.withColumn("length", F.sqrt(square))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of ``a`` and ``b``: by doubles as long as every partial sum is a whole number in them."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The ``k`` best (score, smaller id first) of each of some queries, and the score that each has yet to reach."""

    def __init__(self, reach: np.ndarray, k: int):
        n = len(reach)
        self.k = k
        self.score = np.full((n, k), NONE, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.reach = reach.copy()

    def meet(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes pairs of a query and a candidate, any number for each query."""
        if not len(queries):
            return
        order = np.lexsort((ids, ~score, queries))  # ~score falls as score rises, and has no overflow
        queries, score, ids = queries[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, queries[1:] != queries[:-1]))
        place = np.arange(len(queries)) - np.repeat(first, np.diff(np.append(first, len(queries))))
        some, own = queries[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(queries))))
        few = place < self.k
        s = np.concatenate([self.score[some], np.full((len(some), self.k), NONE, np.int64)], axis=1)
        e = np.concatenate([self.id[some], np.full((len(some), self.k), np.iinfo(np.int64).max, np.int64)], axis=1)
        s[own[few], self.k + place[few]] = score[few]
        e[own[few], self.k + place[few]] = ids[few]
        order = np.lexsort((e, ~s), axis=1)[:, : self.k]
        self.score[some] = np.take_along_axis(s, order, axis=1)
        self.id[some] = np.take_along_axis(e, order, axis=1)
        self.reach[some] = np.maximum(self.reach[some], self.score[some, -1])


@dataclass
class Asked:
    """A group of queries: their directions, and in each the coordinates that tell most."""

    row: np.ndarray
    id: np.ndarray
    x: np.ndarray
    length: np.ndarray
    best: Best

    def __post_init__(self) -> None:
        self.unit = self.x / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]


@dataclass
class Bucket:
    """Vectors of similar length, longest first, and, once a query asks for them, their directions in sorted coordinate lists."""

    row: np.ndarray
    id: np.ndarray
    x: np.ndarray
    length: np.ndarray

    @cached_property
    def unit(self) -> np.ndarray:
        return self.x / np.maximum(self.length, 1e-300)[:, None]

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.unit, axis=0, kind="stable")

    @cached_property
    def sorted(self) -> np.ndarray:
        return np.take_along_axis(self.unit, self.order, axis=0)

    def ranges(self, unit: np.ndarray, focus: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where, in the list of each focus coordinate of each query, the candidates begin and end whose cosine with it may be ``cosine`` or more."""
        angle, open_by = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1, 1)), np.arccos(cosine)[:, None]
        low, high = np.cos(np.minimum(np.pi, angle + open_by)) - 1e-9, np.cos(np.maximum(0, angle - open_by)) + 1e-9
        start, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            own = focus == f
            start[own] = np.searchsorted(self.sorted[:, f], low[own])
            end[own] = np.searchsorted(self.sorted[:, f], high[own], side="right")
        return start, end

    def candidates(self, f: int, start: int, end: int, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray:
        """Of one stretch of the list of coordinate ``f``, the places whose focus coordinates and what length is left beside them allow the cosine."""
        at = self.order[start:end, f]
        part = self.unit[at][:, focus]
        rest = np.sqrt(np.maximum(0, 1 - (part**2).sum(axis=1)) * max(0.0, 1 - float((unit[focus] ** 2).sum())))
        return at[part @ unit[focus] + rest >= cosine - 1e-9]


def retrieve(bucket: Bucket, asked: Asked) -> None:
    """Compares queries with the candidates of one bucket that may reach the score of each."""
    best, most = asked.best, float(bucket.length[0])
    reach = np.where(best.reach == NONE, -np.inf, best.reach.astype(float))
    need = reach - 1e-9 * np.abs(np.where(np.isinf(reach), 0, reach)) - 1e-6
    live = np.flatnonzero(asked.length * most >= need)
    if not len(live):
        return
    cosine = np.clip(np.where(need[live] > 0, need[live] / np.maximum(asked.length[live] * most, 1e-300), 0.0), 0.0, 1.0)
    whole = np.ones(len(live), bool)
    narrow = np.flatnonzero(cosine >= NARROW)
    if len(narrow):
        start, end = bucket.ranges(asked.unit[live[narrow]], asked.focus[live[narrow]], cosine[narrow])
        shortest = (end - start).argmin(axis=1)
        for n, (place, f) in enumerate(zip(narrow.tolist(), shortest.tolist(), strict=True)):
            if end[n, f] - start[n, f] > SHARE * len(bucket.row):
                continue
            whole[place] = False
            i = int(live[place])
            at = bucket.candidates(int(asked.focus[i, f]), int(start[n, f]), int(end[n, f]), asked.unit[i], asked.focus[i], float(cosine[place]))
            at = at[bucket.row[at] != asked.row[i]]
            if len(at):
                score = products(asked.x[i : i + 1], bucket.x[at])[0]
                good = score >= best.reach[i]
                best.meet(np.full(int(good.sum()), i), score[good], bucket.id[at[good]])
    # by length: the shortest candidate that any of the other queries needs ends the prefix that they are multiplied with
    for some in np.split(live[whole], range(TOGETHER, int(whole.sum()), TOGETHER)):
        if not len(some):
            continue
        shortest = float(np.where(need[some] > 0, need[some] / np.maximum(asked.length[some], 1e-300), -np.inf).min())
        n = int(np.searchsorted(-bucket.length, -shortest, side="right")) if np.isfinite(shortest) else len(bucket.row)
        score = products(asked.x[some], bucket.x[:n])
        i, j = np.nonzero((score >= best.reach[some][:, None]) & (bucket.row[:n][None] != asked.row[some][:, None]))
        best.meet(some[i], score[i, j], bucket.id[j])


def packed(size: int, dim: int, extra: bool):
    """Rows (row, vec_id, x, length, [reach]) in their order as one row for each ``size`` of them, as bytes."""
    names = ["longest", "rows", "ids", "xs", "lengths", *(["reaches"] if extra else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(all_of: pa.Table) -> Iterator[pa.RecordBatch]:
            for at in range(0, all_of.num_rows, size):
                some = all_of.slice(at, size).combine_chunks()
                number = lambda c: some.column(c).to_numpy()  # noqa: E731, B023
                flat = some.column("x").combine_chunks().flatten().to_numpy().astype(np.int32)
                columns = [number("row").tobytes(), number("vec_id").tobytes(), flat.tobytes(), number("length").tobytes(), *([number("reach").tobytes()] if extra else [])]
                yield pa.RecordBatch.from_arrays([pa.array([float(number("length").max())]), *[pa.array([c], pa.binary()) for c in columns]], names=names)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                all_of = pa.Table.from_batches(held)
                whole = all_of.num_rows // size * size
                yield from blocks(all_of.slice(0, whole))
                held = all_of.slice(whole).to_batches()
        if sum(b.num_rows for b in held):
            yield from blocks(pa.Table.from_batches(held))

    return run, "longest double, rows binary, ids binary, xs binary, lengths binary" + (", reaches binary" if extra else "")


def top_products(rows: DataFrame, query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer products with all ``rows`` for those that meet ``query`` (a condition on vec_id)."""
    entries = cut(usable(rows, scale, id_col, vector_col))
    n = entries.count()
    queries = entries.where(query)
    n_queries = queries.count()
    first = entries.select("x").first()
    dim = max(1, len(first.x)) if first else 1

    seed = entries.orderBy(F.desc("length"), "vec_id", "row").limit(SEED).toPandas()
    head, head_row = np.array(seed["x"].tolist(), np.int32).reshape(-1, dim), seed["row"].to_numpy(np.int64)

    @F.pandas_udf("long")
    def reach(row, x):
        import pandas as pd

        score = products(np.stack(x.to_list()).astype(np.int32), head) if len(x) else np.zeros((0, len(head)), np.int64)
        if len(head) <= k:
            return pd.Series(np.full(len(x), NONE))
        score[row.to_numpy()[:, None] == head_row[None]] = NONE
        return pd.Series(np.partition(score, len(head) - k, axis=1)[:, len(head) - k])

    queries = queries.withColumn("reach", reach("row", "x"))
    need = F.when(F.col("reach") <= 0, 0.0).when(F.col("length") > 0, F.col("reach") / F.col("length")).otherwise(0.0)
    queries = cut(queries.withColumn("need", need * (1 - 1e-9)))
    grid = sorted(set(queries.approxQuantile("need", [i / LEVELS for i in range(LEVELS)], 1 / LEVELS))) if n_queries else []
    level = lambda c: F.array_size(F.filter(F.array(*map(F.lit, [0.0, *grid])), lambda g: g <= c))

    run, kind = packed(BUCKET, dim, False)
    shards = -(-n // (BUCKET * SHARD)) or 1
    shelf = entries.repartitionByRange(shards, F.desc("length"), "row").sortWithinPartitions(F.desc("length"), "row").mapInArrow(run, kind)
    shelf = cut(shelf.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("bucket"), "*"))
    run, kind = packed(GROUP, dim, True)
    asked = queries.repartitionByRange(-(-n_queries // GROUP) or 1, "need", "row").sortWithinPartitions("need", "row").select("row", "vec_id", "x", "length", "reach")
    asked = asked.mapInArrow(run, kind).select(F.monotonically_increasing_id().alias("group"), "*").withColumn("need", least_need(F.col("lengths"), F.col("reaches")))
    asked = cut(asked)

    # shards and groups meet by level: a shard has all levels up to its longest vector's, a group that of its smallest need
    reached = shelf.groupBy("shard").agg(F.max("longest").alias("longest")).select("shard", F.explode(F.sequence(F.lit(1), level(F.col("longest")))).alias("level"))
    pairs = cut(reached.join(asked.select("group", level(F.col("need")).alias("level")), "level").select("shard", "group"))
    left = pairs.join(shelf, "shard").select("shard", "group", "bucket", "rows", "ids", "xs", "lengths")
    right = pairs.join(asked, "group").select(F.col("shard").alias("to"), F.col("group").alias("of"), "rows", "ids", "xs", "lengths", "reaches")

    def compare(buckets: pa.Table, some: pa.Table) -> pa.Table:
        numbers = lambda t, c, i, kind=np.int64: np.frombuffer(t.column(c)[i].as_py(), kind)
        vectors = lambda t, i: numbers(t, "xs", i, np.int32).reshape(-1, dim)
        groups = [Asked(numbers(some, "rows", g), numbers(some, "ids", g), vectors(some, g), numbers(some, "lengths", g, float), Best(numbers(some, "reaches", g), k)) for g in range(some.num_rows)]
        for b in np.argsort(buckets.column("bucket").to_numpy()).tolist():
            bucket = Bucket(numbers(buckets, "rows", b), numbers(buckets, "ids", b), vectors(buckets, b), numbers(buckets, "lengths", b, float))
            for g in groups:
                retrieve(bucket, g)
        out = [pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "score")})]
        for g in groups:
            i, j = np.nonzero(g.best.score != NONE)
            out.append(pa.table({"query": g.row[i], "query_id": g.id[i], "vec_id": g.best.id[i, j], "score": g.best.score[i, j]}))
        return pa.concat_tables(out)

    found = left.groupBy("shard", "group").cogroup(right.groupBy("to", "of")).applyInArrow(compare, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def least_need(lengths: Column, reaches: Column) -> Column:
    """The smallest length that any query of a group needs of a candidate."""

    @F.pandas_udf("double")
    def run(a, b):
        import pandas as pd

        def one(x: bytes, y: bytes) -> float:
            size, score = np.frombuffer(x, float), np.frombuffer(y, np.int64)
            return float(np.where((score > 0) & (size > 0), score / np.maximum(size, 1e-300), 0.0).min() * (1 - 1e-9))

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return run(lengths, reaches)


def op13_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op13_norm_bucket_topk": op13_norm_bucket_topk}

ORACLES = {
    "op13_norm_bucket_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
}
