"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are projected on Gaussian directions, shifted and cut into steps of equal width; the steps of one table are a
bucket. Every query visits, beside its own bucket, the perturbed buckets in the order of their estimated success: a
neighbour at distance r is off by a Gaussian of deviation r along each direction, which gives each perturbation a
probability. Each table is probed until the buckets visited hold such a neighbour with probability ``target`` over all tables, so the number of probes
follows the data and has no cap of its own. The distance r and the width are fitted on a bounded sample (``SAMPLE`` rows); every
row is indexed. Candidates of all tables are ranked by their exact distance.

Exact copies share one index entry for the smallest ids that can matter, as many as results are asked for and one more, so a
vector that a third of the rows share is compared once; queries of one vector are one search. The buckets to probe grow much
faster than the rows where vectors have no clusters, so they are not listed: a query carries for each table how likely a bucket
must be to be visited (``Hashing.reach``), and the tasks that hold buckets work out which queries visit them. Entries are dealt
out by their buckets in one table, full ones in salted pieces, to parts, and once for each block of ``BLOCK`` queries; queries go to each part once,
which makes no more rows than the entries. Tasks keep only the nearest few of each query. Queries that met fewer than asked for
are compared with every entry.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; ties go to the smaller id; repeated rows (same id and vector) are one row; several vectors under one id are rows of
their own, each a candidate (also of the others) and each a query; rows with a null id take no part; with fewer candidates than asked for, the others
are missing; empty tables give an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.session import cut, table

#: Bound of the fitted sample.
SAMPLE = 2_000
TABLES, TARGET, SEED = 2, 0.97, 8
#: Entries that a bucket holds on average, and entries of a bucket in one part.
FILL, PART = 256, 512
#: Parts up to which ``PART`` holds, entries of a part from there on, and queries of a block.
PARTS, LARGE, BLOCK = 32, 262_144, 65_536
#: Entries and queries compared at a time, and pairs whose exact distance waits to be ranked.
CHUNK, SUB, PENDING = 512, 1_024, 100_000
#: Draws by which the probability of a bucket to visit is found, and the least logarithm of one along an axis.
DRAWS, LEAST = 1_024, -700.0


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: the vectors that take part, in double precision."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


class Hashing:
    """The fitted tables: directions, shifts, width, and the distance that probing reckons with."""

    def __init__(self, sample: np.ndarray, rows: int, nearest: int, tables: int = TABLES, target: float = TARGET, fill: int = FILL):
        rng = np.random.default_rng(SEED)
        self.dim = sample.shape[1]
        norms = np.sqrt((sample**2).sum(1))
        # deviation of a projection on a Gaussian direction; the width of steps follows it
        scale = max(math.sqrt(sample.var(axis=0).sum()) if len(sample) else 0.0, 1e-9 * float(norms.max(initial=0)), 1e-100)
        self.width = 1.5 * scale
        bits = 1.46  # entropy of a Gaussian cut at 1.5 deviations
        self.k = max(1, round(math.log2(max(2.0, rows / fill)) / bits))
        self.directions = rng.standard_normal((tables, self.k, self.dim))
        self.shift = rng.random((tables, self.k)) * self.width
        self.each = 1 - (1 - target) ** (1 / tables)
        # the nearest-th neighbour among all rows: of the pairs of the sample, the share that are as near
        probe = sample[:: max(1, len(sample) // 200)]
        d = np.sqrt(np.maximum(0, (probe**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * probe @ sample.T))
        d = np.sort(d, axis=1)[:, 1:]
        at = min(d.shape[1] - 1, max(nearest - 1, round(d.shape[1] * nearest / max(rows, 1)))) if d.shape[1] else 0
        self.radius = float(np.quantile(d[:, at], 0.9)) if d.size else scale
        self.radius = max(self.radius, 1e-6 * scale)

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Rows by tables by k: position along each direction in units of the width."""
        return (np.einsum("nd,tkd->ntk", x, self.directions, optimize=True) + self.shift) / self.width

    def key(self, cells: np.ndarray) -> np.ndarray:
        """One number for each bucket (the last axis)."""
        out = np.full(cells.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(cells.shape[-1]):
                out = (out ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def probes(self, position: np.ndarray) -> np.ndarray:
        """Cells to visit around one position of one table, the likeliest first, until ``each`` of the probability is covered."""
        reach = max(1, math.ceil(3 * self.radius / self.width))
        offset = np.arange(-reach, reach + 1)
        home = np.floor(position)
        low = (home[:, None] + offset - position[:, None]) * self.width / self.radius
        mass = _normal(low + self.width / self.radius) - _normal(low)
        beam = np.array([[1.0]]), np.zeros((1, 0), np.int64)
        keep = 64
        while True:
            p, cells = beam[0][0], beam[1]
            for axis in range(self.k):
                q = (p[:, None] * mass[axis][None]).ravel()
                order = np.argsort(-q, kind="stable")[:keep]
                cells = np.concatenate([cells[order // len(offset)], offset[order % len(offset)][:, None]], axis=1)
                p = q[order]
            covered = np.cumsum(p)
            if covered[-1] >= self.each or len(p) < keep or keep >= len(offset) ** self.k:
                return home.astype(np.int64) + cells[: int(np.searchsorted(covered, self.each)) + 1]
            keep *= 4

    def logs(self, low: np.ndarray) -> np.ndarray:
        """Logarithm of the probability that a neighbour is in a step that begins ``low`` units of the width away, along one direction."""
        at = low * (self.width / self.radius)
        return np.log(np.maximum(_normal(at + self.width / self.radius) - _normal(at), math.exp(LEAST)))

    def reach(self, position: np.ndarray) -> np.ndarray:
        """Rows by tables: the least logarithm of a bucket's probability that a query visits.

        The buckets above it, the likeliest ones, hold such a neighbour with the probability ``each``: so many of the neighbours
        that are drawn fall into them. These are the buckets that ``probes`` lists.
        """
        far = max(1, math.ceil(5 * self.radius / self.width))
        draws = np.random.default_rng(SEED).standard_normal((DRAWS, self.k)) * (self.radius / self.width)
        out = np.zeros(position.shape[:2])
        offset, axis = np.arange(-far, far + 1), np.arange(self.k)
        rank = int((1 - self.each) * DRAWS)
        for a in range(0, len(position), 64):
            for t in range(position.shape[1]):
                past = position[a : a + 64, t] - np.floor(position[a : a + 64, t])
                mass = self.logs(offset - past[..., None])
                cell = np.clip(np.floor(past[:, None] + draws), -far, far).astype(np.int64) + far
                logs = mass[np.arange(len(past))[:, None, None], axis, cell].sum(axis=2)
                out[a : a + 64, t] = np.partition(logs, rank, axis=1)[:, rank] - 1e-4
        return out


def _normal(x: np.ndarray) -> np.ndarray:
    """The Gaussian distribution function (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Nearest:
    """The nearest ``n`` entries of each query of a block met so far: squared distances, smallest ids and entries, in this order."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, reach: np.ndarray, model: Hashing, n: int):
        self.ids, self.q, self.model, self.n = ids, q, model, n
        self.at = np.concatenate([model.steps(q[a : a + SUB].astype(float)) for a in range(0, len(q), SUB)])
        self.limit = reach.T.astype(np.float32)
        self.d = np.full((len(q), n), np.inf)
        self.low, self.entry = np.zeros((len(q), n), np.int64), np.full((len(q), n), -1)
        self.logs: dict[tuple[int, int, int, int], np.ndarray] = {}
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def axis(self, t: int, axis: int, cells: np.ndarray, a: int) -> np.ndarray:
        """Steps by some queries: the logarithms of ``Hashing.logs``. A bounded number is kept."""
        if len(self.logs) > 16_000:
            self.logs = {}
        for c in cells.tolist():
            if (t, axis, c, a) not in self.logs:
                self.logs[t, axis, c, a] = self.model.logs(c - self.at[a : a + SUB, t, axis]).astype(np.float32)
        return np.stack([self.logs[t, axis, c, a] for c in cells.tolist()])

    def sums(self, t: int, x: np.ndarray) -> tuple[list, np.ndarray]:
        """How to add up the logarithms of entries over the axes: what is common to several entries is added once. Axes, then sums of two earlier ones."""
        cells = np.floor((x @ self.model.directions[t].T + self.model.shift[t]) / self.model.width).astype(np.int64)
        steps: list = [np.unique(column, return_inverse=True) for column in cells.T]
        nodes = [(k, len(values), of) for k, (values, of) in enumerate(steps)]
        steps = [values for values, _ in steps]
        while len(nodes) > 1:
            (left, _, i), (right, n, j) = nodes[:2]
            pairs, of = np.unique(i * n + j, return_inverse=True)
            steps.append((left, pairs // n, right, pairs % n))
            nodes = [*nodes[2:], (len(steps) - 1, len(pairs), of)]
        return steps, nodes[0][2]

    def visits(self, t: int, steps: list, a: int) -> np.ndarray:
        """Buckets of the entries by some queries: which are visited."""
        made: list[np.ndarray] = []
        for k, step in enumerate(steps):
            made.append(self.axis(t, k, step, a) if k < self.model.k else made[step[0]][step[1]] + made[step[2]][step[3]])
        return made[-1] >= self.limit[t, a : a + SUB]

    def meet(self, entries: np.ndarray, least: np.ndarray, x: np.ndarray) -> None:
        """Compares some entries with the queries that visit one of their buckets. Exact distances are taken wherever fast ones could decide wrongly."""
        tables = [self.sums(t, x) for t in range(len(self.limit))]
        x2 = (x**2).sum(1)
        wide = np.concatenate([-2 * x, x2[:, None], np.ones((len(x), 1))], axis=1)
        short = wide.astype(np.float32) if x2.max() < 1e30 else None
        for a in range(0, len(self.q), SUB):
            visits = np.zeros((len(x), min(SUB, len(self.q) - a)), bool)
            for t, (steps, of) in enumerate(tables):
                visits |= self.visits(t, steps, a)[of]
            some = np.flatnonzero(visits.any(axis=0))
            if not len(some):
                continue
            visits = visits if len(some) == visits.shape[1] else visits[:, some]
            q = self.q[a + some].astype(float)
            q2 = (q**2).sum(1)
            tall = np.concatenate([q, np.ones((len(q), 1)), q2[:, None]], axis=1)
            scale = q2 + x2.max()
            if short is not None and 1e-20 < scale.min() and scale.max() < 1e30:  # single precision rules out most pairs
                fast, slack = short @ tall.astype(np.float32).T, 5e-7 * tall.shape[1] * scale
            else:
                fast, slack = wide @ tall.T, 1e-9 * scale
            most = self.d[a + some, -1]
            if len(new := np.flatnonzero(np.isinf(most))) and len(x) > self.n:
                most[new] = np.partition(np.where(visits[:, new], fast[:, new], np.inf), self.n - 1, axis=0)[self.n - 1]
            e, i = np.divmod(np.flatnonzero((fast <= (most + slack).astype(fast.dtype)) & visits), len(some))
            for b in range(0, len(e), PENDING):
                near, to = e[b : b + PENDING], i[b : b + PENDING]
                d = ((x[near] - q[to]) ** 2).sum(axis=1)
                self.pending.append((a + some[to], d, least[near], entries[near]))
                self.waiting += len(d)
                if self.waiting >= PENDING:
                    self.rank()

    def rank(self) -> None:
        if not self.pending:
            return
        row, d, low, e = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        self.pending, self.waiting = [], 0
        rows = np.unique(row)
        known = self.entry[rows] >= 0
        d, low, e = (np.concatenate([old[rows][known], new]) for old, new in ((self.d, d), (self.low, low), (self.entry, e)))
        row = np.concatenate([np.repeat(rows, self.n).reshape(known.shape)[known], row])
        order = np.lexsort((e, low, d, row))
        row, d, low, e = row[order], d[order], low[order], e[order]
        first = np.concatenate(([True], (row[1:] != row[:-1]) | (e[1:] != e[:-1])))  # an entry's distance is the same whenever it is met
        row, d, low, e = row[first], d[first], low[first], e[first]
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        place = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        keep = place < self.n
        row, place = row[keep], place[keep]
        self.d[row, place], self.low[row, place], self.entry[row, place] = d[keep], low[keep], e[keep]

    def found(self) -> Iterator[pa.RecordBatch]:
        self.rank()
        for a in range(0, len(self.q), SUB):
            row, place = np.nonzero(self.entry[a : a + SUB] >= 0)
            columns = self.ids[a + row], self.entry[a + row, place], self.low[a + row, place], self.d[a + row, place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "entry", "least", "d2"])


def search(nearest: int, model: Hashing):
    """Reads (part, block, is_entry, key, id, least, reach, v) sorted in this order, queries before entries; gives the nearest entries of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, group = None, None
        asked: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            head = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            row_id, least, v = batch.column(4).to_numpy(), batch.column(5).to_numpy(), _matrix(batch.column(7))
            at = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]).any(axis=1), [True])))
            for a, b in zip(at, at[1:], strict=False):
                if group is None or (head[a, :2] != group).any():
                    if best:
                        yield from best.found()
                    best, group, asked = None, head[a, :2].copy(), []
                if not head[a, 2]:
                    asked.append((row_id[a:b], v[a:b], _matrix(batch.column(6).slice(a, b - a))))
                elif asked or best:
                    if asked:
                        best, asked = Nearest(*(np.concatenate(x) for x in zip(*asked, strict=True)), model, nearest), []
                    for c in range(a, b, CHUNK):
                        end = min(b, c + CHUNK)
                        best.meet(row_id[c:end], least[c:end], v[c:end].astype(float))
        if best:
            yield from best.found()

    return run


def copies(one: DataFrame, nearest: int) -> DataFrame:
    """``h1, h2, ids``: of each distinct vector, the smallest ids that can matter. Taken in two steps, so a common vector is no task's alone."""
    part = Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = one.withColumn("n", F.row_number().over(part)).where(F.col("n") <= nearest + 1)
    return few.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, nearest + 1).alias("ids"))


def nearest_neighbours(rows: DataFrame, query: Column, nearest: int = 10, tables: int = TABLES, target: float = TARGET, fill: int = FILL, part: int = PART) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of all ``rows`` (vec_id, embedding) for those that meet ``query`` (a condition on vec_id)."""
    base = usable(rows).withColumn("n", F.size("v")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(SEED), "v"))
    if dict(rows.dtypes)["embedding"] == "array<float>":
        base = base.withColumn("v", F.col("v").cast("array<float>"))  # loses nothing, and half the bytes are moved
    seen = cut(base.select("vec_id", "n", "h1", "h2").distinct())  # vectors are read again where they are needed, each kept once
    lengths = seen.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = lengths.n if lengths else 1
    base, seen = base.where(F.col("n") == dim), seen.where(F.col("n") == dim)
    entries = base.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(copies(seen, nearest), ["h1", "h2"])
    entries = cut(entries.select("h1", "h2", F.element_at("ids", 1).alias("least"), "ids", "v", F.monotonically_increasing_id().alias("entry")))
    queries = base.where(query).dropDuplicates(["vec_id", "h1", "h2"]).join(entries.select("h1", "h2", F.col("entry").alias("own")), ["h1", "h2"])
    queries = cut(queries.select("vec_id", "own", "v").withColumn("query", F.monotonically_increasing_id()))

    sample = entries.select("least", "h1", "v").orderBy(F.xxhash64("least", "h1"), "least", "h1").limit(SAMPLE).toPandas()
    total = entries.count()
    model = Hashing(np.array(sample["v"].tolist(), float).reshape(-1, dim), total, nearest, tables, target, fill)

    @F.pandas_udf("bigint")
    def key(v):
        import pandas as pd

        x = np.stack(v.to_list()).astype(float) if len(v) else np.zeros((0, dim))
        return pd.Series(model.key(np.floor(model.steps(x))[:, 0]))

    @F.pandas_udf("array<double>")
    def reach(v):
        import pandas as pd

        return pd.Series(list(model.reach(model.steps(np.stack(v.to_list()).astype(float)))) if len(v) else [], dtype=object)

    asked = cut(queries.dropDuplicates(["own"]).select(F.col("own").alias("query"), "v", reach("v").alias("reach")))
    found = cut(ranked(dealt(entries.select("entry", "least", "v", key("v").alias("key")), total, asked, part), entries, nearest, model))
    columns = ["query_id", "rank", "vec_id", "score"]
    out = cut(answers(found, queries, nearest))

    # queries that met too few: compared with every entry
    least = min(nearest, seen.count() - 1)
    short = queries.join(out.groupBy("query").agg(F.count("*").alias("n")), "query", "left").where(F.coalesce("n", F.lit(0)) < least)
    short = cut(short.select("query", "own", "vec_id", "v"))
    if not short.count():
        return out.select(*columns)
    asked = cut(short.dropDuplicates(["own"]).select(F.col("own").alias("query"), "v", F.array_repeat(F.lit(float("-inf")), tables).alias("reach")))
    whole = answers(ranked(dealt(entries.select("entry", "least", "v", F.col("entry").alias("key")), total, asked, part), entries, nearest, model), short, nearest)
    return out.join(short.select("query"), "query", "left_anti").unionByName(whole).select(*columns)


def dealt(rows: DataFrame, n: int, asked: DataFrame, part: int) -> DataFrame:
    """``part, block, is_entry, key, id, least, reach, v`` of ``n`` entries (entry, least, v, key) and of queries (query, v, reach).

    Entries go to parts by their bucket in the first table, and the tasks find those of the other tables. Buckets that would fill much of a part are dealt out in pieces: these are counted, and
    there are sixteen for each part at most.
    """
    queries = asked.count()
    blocks = math.ceil(queries / BLOCK) or 1
    parts = max(1, min(math.ceil(n / part), max(PARTS, math.ceil(n / LARGE)), math.ceil(n * blocks / max(1, queries))))
    piece = max(part, math.ceil(n / parts / 16))
    full = cut(rows.groupBy("key").agg(F.ceil(F.count("*") / piece).alias("pieces")).where("pieces > 1"))
    pick = lambda n, *c: F.pmod(F.xxhash64(*c), n if isinstance(n, Column) else F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    here = rows.join(F.broadcast(full), "key", "left").withColumn("piece", pick(F.coalesce("pieces", F.lit(1).cast("long")), "entry"))
    here = here.select(pick(parts, "key", "piece").cast("int").alias("part"), every(blocks).alias("block"), F.lit(1).alias("is_entry"), "key", F.col("entry").alias("id"), "least", F.lit(None).cast("array<double>").alias("reach"), "v")
    there = asked.select(every(parts).alias("part"), pick(blocks, "query").cast("int").alias("block"), F.lit(0).alias("is_entry"), F.lit(0).cast("long").alias("key"), F.col("query").alias("id"), F.lit(0).cast("long").alias("least"), "reach", "v")
    return here.unionByName(there)


def ranked(rows: DataFrame, entries: DataFrame, nearest: int, model: Hashing) -> DataFrame:
    """``own, entry, vec_id, score`` from dealt entries and queries (entries themselves): the nearest rows of each query, its own among them."""
    rows = rows.repartition("part", "block").sortWithinPartitions("part", "block", "is_entry", "key")
    found = rows.mapInArrow(search(nearest + 1, model), "query long, entry long, least long, d2 double").distinct()
    first = Window.partitionBy("query").orderBy("d2", "least", "entry")
    found = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= nearest + 1).select(F.col("query").alias("own"), "entry", "d2")
    found = found.join(entries.select("entry", "ids"), "entry").select("own", "entry", F.explode("ids").alias("vec_id"), F.sqrt("d2").alias("score"))
    rank = F.row_number().over(Window.partitionBy("own").orderBy("score", "vec_id", "entry"))
    return found.withColumn("n", rank).where(F.col("n") <= nearest + 1).drop("n")


def answers(found: DataFrame, queries: DataFrame, nearest: int) -> DataFrame:
    """``query, query_id, rank, vec_id, score``: the nearest rows of each query's vector, without the query's own row."""
    rows = queries.select("query", F.col("vec_id").alias("query_id"), "own").join(found, "own")
    rows = rows.where((F.col("vec_id") != F.col("query_id")) | (F.col("entry") != F.col("own")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "entry"))
    return rows.withColumn("rank", rank.cast("int")).where(F.col("rank") <= nearest).select("query", "query_id", "rank", "vec_id", "score")


def op8_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op8_multiprobe_neighbours": op8_multiprobe_neighbours}
ORACLES: dict[str, str] = {}
