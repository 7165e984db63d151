"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Every document gets one SimHash of its word shingles. Two fingerprints are linked when at most ``reach`` bits differ,
and components of linked fingerprints are the groups of near-duplicates.

Links are found with covering masks: bit ``i`` carries a non-zero vector ``m(i)`` of ``r + 1`` bits, and mask
``v`` (one for each non-zero ``v``) keeps the bits whose ``m(i)`` has an odd inner product with ``v``. The vectors
of at most ``r`` differing bits span at most ``r`` dimensions, so some ``v`` is orthogonal to all of them: that
mask hides every differing bit and the pair meets in its table. No pair within the radius is missed. A fingerprint of
several words has masks over each word, and one word of a pair within the radius has no more than its part of the bits.

With ``similarity``, fingerprints only propose pairs, and a link is a pair whose shingle sets have that Jaccard
similarity. Texts are then compared in two rounds: pairs that span each group of proposed pairs, and, in groups that
fall apart, all other pairs of different parts that meet in a bucket, the nearer ones first. A pair is left uncompared only
where links that were found join its two texts already, so no link is lost. In groups of up to ``FEW_TEXTS`` these pairs are found
by comparing all fingerprints, a block with a block; members of larger groups are dealt to their buckets. Groups that unrelated
texts chain together by chance have few such pairs for their size; these are named one by one. Where a share of all pairs of a
group meets (``DENSE``), the group is compared in pairs of blocks, and no pair leaves its task.

Defined results: a null text is an empty text and has fingerprint 0, linked like any other; a null ``doc_id`` is an id
like any other, but the last one, so a group has component_id null only if none of its rows has an id; repeated rows
each come back with the same values; an empty table gives an empty result; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riffle.session import cut, discard, stored, table

LOWER = bytes(range(256)).replace(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles hashed at a time: the memory that a very long text takes.
BLOCK = 1 << 16
#: Fingerprints of one bucket that one task compares; larger buckets are compared in pairs of blocks.
MAX_BUCKET = 20_000
#: Buckets up to this size are compared by shifted arrays, all at once.
SMALL = 48
#: Shingles and texts that are compared as sets in one block; two blocks meet in a task.
SET_GRAMS, SET_TEXTS = 1 << 18, 1_024
#: The fingerprints of a group of up to so many texts are compared in pairs of blocks of about so many: a text goes to 8 units at
#: most. In larger groups it goes to its buckets, 93 of them in ``WIDE``.
FEW_TEXTS, FEW_BLOCK = 8_192, 1_024
#: A group is compared whole if so many times the pairs that meet under the masks of the first word are its texts squared.
DENSE = 32


@dataclass(frozen=True)
class Shape:
    """Fingerprints of ``words`` words of ``width`` bits. The masks of a word cover ``each`` differing bits of it; a pair is linked or proposed within ``reach`` bits."""

    words: int = 1
    width: int = 64
    each: int = 4
    reach: int = 4
    #: Bits within which pairs are looked at first.
    near: int = 4

    @property
    def covered(self) -> int:
        """Pairs that differ in so many bits meet with certainty."""
        return self.words * (self.each + 1) - 1

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(self.words)]

    @cached_property
    def masks(self) -> list[tuple[int, int]]:
        """Word and mask of each table."""
        return [(w, m) for w in range(self.words) for m in covering_masks(self.each, range(self.width))]

    def tables(self, words: int | None = None) -> Column:
        """An array of ``t, k``: the bucket of a fingerprint in each table, or in those of the first ``words`` words."""
        some = [(t, w, m) for t, (w, m) in enumerate(self.masks) if words is None or w < words]
        return F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"f{w}").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, w, m in some])

    def first_table(self, differ: list[np.ndarray]) -> np.ndarray:
        """The first table in which pairs meet that differ in these bits; a pair may meet in several, and counts in one."""
        out = np.full(len(differ[0]), -1)
        for at in range(0, len(out), 1 << 13):
            part = [d[at : at + (1 << 13)] for d in differ]
            hit = np.concatenate([(d[:, None] & np.array([m for x, m in self.masks if x == w], np.uint64)) == 0 for w, d in enumerate(part)], axis=1)
            out[at : at + (1 << 13)] = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
        return out


#: What the contract of the query names: XXH64 and 4 of 64 bits.
PLAIN = Shape()
#: For similarity 0.8: such texts differ in about 15 of 96 bits. All pairs of 14 bits meet, and most up to 22, the reach.
WIDE = Shape(words=3, width=32, each=4, reach=22, near=8)


def covering_masks(radius: int, bits: range = range(64)) -> list[int]:
    """The 2^(radius+1)-1 masks over ``bits``; vectors are dealt in turn, so that the masks are of nearly equal weight."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, shingle: int, wide: bool = False) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, repeats included, as rows of bytes: XXH64 (seed 42), or XXH3 of 128 bits if ``wide``."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(words)
    if not n:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    del words
    end = np.cumsum(size + 1) - 1
    start = end - size
    total = max(1, n - shingle + 1)
    end = end[shingle - 1 :] if n >= shingle else end[-1:]
    digest = xxhash.xxh3_128_digest if wide else xxhash.xxh64_digest
    for at in range(0, total, BLOCK):
        spans = zip(start[at : min(at + BLOCK, total)].tolist(), end[at : at + BLOCK].tolist(), strict=True)
        yield np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans]), np.uint8).reshape(-1, 16 if wide else 8)


def fingerprint(text: str | None, shingle: int, shape: Shape = PLAIN) -> list[int]:
    return _fingerprint(shingle_hashes(text, shingle, shape.words > 1), shape)


def _fingerprint(blocks: Iterable[np.ndarray], shape: Shape) -> list[int]:
    each = shape.width // 8
    ones, total = np.zeros(shape.words * shape.width, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h[:, : each * shape.words], axis=1).sum(axis=0, dtype=np.int64)
        total += len(h)
    bits = np.packbits(ones * 2 > total).tobytes() if total else bytes(each * shape.words)
    return [int.from_bytes(bits[each * w : each * (w + 1)], "big") for w in range(shape.words)]


def gram_set(blocks: Iterable[np.ndarray]) -> np.ndarray:
    """The distinct shingles of a text, in order."""
    found = [np.ascontiguousarray(h[:, :8]).view(np.int64).ravel() for h in blocks]
    return np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))


def fingerprints(docs: DataFrame, shingle: int = 4, shape: Shape = PLAIN, sets: bool = False) -> DataFrame:
    """``doc_id, tag, f0, ...``: the SimHash of each whole text. tag is a hash of the text.

    With ``sets``, also ``kin``, 128 bits that stand for the set of shingles, and ``n``, its size.
    """
    kind = "doc_id long, tag long, " + ", ".join(f"{c} long" for c in shape.columns) + (", kin binary, n int" if sets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, kin, n = np.zeros((batch.num_rows, shape.words), np.uint64), [], []
            for i, t in enumerate(batch.column(1)):
                blocks = shingle_hashes(t.as_py(), shingle, shape.words > 1)
                if sets:
                    blocks = list(blocks)
                    own = gram_set(blocks)
                    kin.append(xxhash.xxh3_128_digest(own.tobytes()))
                    n.append(len(own))
                fps[i] = _fingerprint(blocks, shape)
            columns = [batch.column(0), batch.column(2), *[pa.array(np.ascontiguousarray(fps[:, w]).view(np.int64)) for w in range(shape.words)]]
            columns += [pa.array(kin, pa.binary()), pa.array(n, pa.int32())] if sets else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", *shape.columns, "kin", "n"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag")).mapInArrow(run, kind)


def apart(fp: list[np.ndarray], a: np.ndarray | slice | int, b: np.ndarray | slice) -> np.ndarray:
    """Differing bits of the fingerprints at places ``a`` and ``b``."""
    out = np.bitwise_count(fp[0][a] ^ fp[0][b])
    for f in fp[1:]:
        out = out + np.bitwise_count(f[a] ^ f[b])
    return out


def forest(pairs: np.ndarray) -> np.ndarray:
    """Places of the index pairs that join two trees: the links without the redundant ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        if (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def tree_links(fp: list[np.ndarray], radius: int) -> np.ndarray:
    """Pairs of positions that span the components of one bucket: each one reached is compared with those not yet reached."""
    left, links = np.arange(len(fp[0])), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = apart(fp, left, at) <= radius
            if near.any():
                found, left = left[near], left[~near]
                links += [(at, x) for x in found]
                frontier += found.tolist()
    return np.array(links, dtype=np.int64).reshape(-1, 2)


def small_links(group: np.ndarray, fp: list[np.ndarray], radius: int) -> np.ndarray:
    """Links inside many small adjacent groups at once: each element against the one d places on."""
    found = []
    for d in range(1, SMALL):
        same = np.flatnonzero(group[d:] == group[:-d])
        if not len(same):
            break
        at = same[apart(fp, same, same + d) <= radius]
        found.append(np.stack([at, at + d], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    pairs = pairs[np.argsort(apart(fp, pairs[:, 0], pairs[:, 1]), kind="stable")]
    return pairs[forest(pairs)]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def bucket_links(shape: Shape, max_bucket: int):
    """Reads rows (t, k, f...) sorted by bucket (t, k). Gives links as (-1, 0, f..., g..., d) and members of larger buckets as (t, k, f..., 0..., 0).

    A link is given only in the first table in which its pair meets. That loses nothing: by induction over the tables,
    the pairs of a tree that were left out are joined by links of earlier tables.
    """
    names = ["t", "k", *shape.columns, *[f"g{i}" for i in range(shape.words)], "d"]

    def batch(t: np.ndarray, k: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(k), *[pa.array(x.view(np.int64)) for x in (*a, *b)], pa.array(d.astype(np.int32))], names=names)

    def links(t: np.ndarray, fp: list[np.ndarray], pairs: np.ndarray) -> pa.RecordBatch:
        x, y = pairs[:, 0], pairs[:, 1]
        own = shape.first_table([f[x] ^ f[y] for f in fp]) == t[x]
        x, y = x[own], y[own]
        return batch(np.full(len(x), -1), np.zeros(len(x), np.int64), [f[x] for f in fp], [f[y] for f in fp], apart(fp, x, y))

    def hot_rows(t: np.ndarray, k: np.ndarray, fp: list[np.ndarray]) -> pa.RecordBatch:
        return batch(t, k, fp, [np.zeros_like(f) for f in fp], np.zeros(len(t)))

    def whole(t: np.ndarray, k: np.ndarray, *fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        first = _starts(t, k)
        size = np.diff(np.append(first, len(t)))
        few = np.repeat((size > 1) & (size <= SMALL), size)
        if few.any():
            some = [f[few] for f in fp]
            yield links(t[few], some, small_links(np.repeat(first, size)[few], some, shape.reach))
        for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            part = [f[at : at + n] for f in fp]
            for r in sorted({min(shape.near, shape.reach), shape.reach}):
                yield links(t[at : at + n], part, tree_links(part, r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        hot = None  # the bucket that has outgrown this task
        for part in batches:
            g = [part.column(i).to_numpy() for i in range(2 + shape.words)]
            g[2:] = [f.view(np.uint64) for f in g[2:]]
            if hot is not None:
                more = (g[0] == hot[0]) & (g[1] == hot[1])
                yield hot_rows(g[0][more], g[1][more], [f[more] for f in g[2:]])
                g = [x[~more] for x in g]
            if not len(g[0]):
                continue
            hot = None
            g = [np.concatenate(x) for x in zip(*held, g, strict=True)]
            last = int(np.argmax((g[0] == g[0][-1]) & (g[1] == g[1][-1])))
            yield from whole(*[x[:last] for x in g])
            g = [x[last:] for x in g]
            held = [g]
            if len(g[0]) > max_bucket:
                yield hot_rows(g[0], g[1], g[2:])
                hot, held = (g[0][0], g[1][0]), []
        for g in held:
            yield from whole(*g)

    return run


def block_links(hot: DataFrame, shape: Shape, block: int) -> DataFrame:
    """Links inside the buckets that are too large for one task: blocks of about ``block`` members, each pair of blocks in a task."""
    sizes = hot.groupBy("t", "k").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    rows = hot.join(sizes, ["t", "k"]).withColumn("c", F.pmod(F.xxhash64(*shape.columns), F.col("n")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("t", "k", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"), *shape.columns)
    ends = [*shape.columns, *[f"g{i}" for i in range(shape.words)]]

    def compare(part: pa.Table) -> pa.Table:
        fp = np.unique(np.stack([part.column(c).to_numpy() for c in shape.columns]), axis=1).view(np.uint64)
        fp = [np.ascontiguousarray(f) for f in fp]
        pairs = np.concatenate([tree_links(fp, r) for r in sorted({min(shape.near, shape.reach), shape.reach})])
        columns = [f[pairs[:, i]].view(np.int64) for i in range(2) for f in fp]
        return pa.table([*map(pa.array, columns), pa.array(apart(fp, pairs[:, 0], pairs[:, 1]).astype(np.int32))], names=[*ends, "d"])

    return rows.groupBy("t", "k", "i", "j").applyInArrow(compare, ", ".join(f"{c} long" for c in ends) + ", d int")


def near_links(nodes: DataFrame, shape: Shape = PLAIN, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links ``f0, ..., g0, ..., d`` (differing bits) that connect all of the distinct fingerprints ``f0, ...`` of ``nodes`` within reach of each other."""
    rows = nodes.select(*shape.columns, F.inline(shape.tables())).select("t", "k", *shape.columns)
    rows = rows.repartition("t", "k").sortWithinPartitions("t", "k", *shape.columns)  # the same links at every run
    ends = [*shape.columns, *[f"g{i}" for i in range(shape.words)]]
    found = cut(rows.mapInArrow(bucket_links(shape, max_bucket), "t int, k long, " + ", ".join(f"{c} long" for c in ends) + ", d int"))
    return cut(found.where("t < 0").select(*ends, "d").unionByName(block_links(found.where("t >= 0"), shape, max_bucket // 2)))


def components(links: DataFrame) -> DataFrame:
    """``node, root``: each linked node with the smallest node that it reaches (alternating large and small stars).

    The smallest neighbours are kept as a table, so that the join with them stands alone and a hub's part of it can be split.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    seen, before = None, []
    while True:
        written: list[str] = []
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), written)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = Observation()
        edges = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(edges.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), written)
        now = state.get
        discard(edges.sparkSession, before)  # the round before is needed no longer
        if now == seen:
            discard(edges.sparkSession, written[:1])
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, before = now, written


def near_duplicates(docs: DataFrame, shingle: int = 4, shape: Shape = PLAIN, similarity: float | None = None, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row ``doc_id, tag, f0, ..., component_id, stays`` for each document; component_id is the smallest doc_id that it reaches by links.

    With ``similarity``, links are pairs of that Jaccard similarity. ``stays`` marks one text of each group: the one with
    that id, and of several under it the one with the smallest tag.
    """
    prints = cut(fingerprints(docs, shingle, shape, similarity is not None))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", *([] if similarity is None else [*shape.columns, "n"])))
    key = shape.columns if similarity is None else ["kin"]  # texts of one fingerprint may have nothing else in common
    nodes = cut(prints.groupBy(*key).agg(first.alias("first")).withColumn("node", F.monotonically_increasing_id()))
    if similarity is None:
        links = of_heads(nodes, near_links(nodes, shape, max_bucket), shape)
    else:
        links = similar_links(docs, nodes, shingle, shape, similarity, max_bucket)
    tied = cut(nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")).select(*key, "root", F.struct("first.none", "first.doc_id", "first.tag").alias("first")))
    least = cut(tied.groupBy("root").agg(F.min("first").alias("first")))  # kept, so that a large group's part of the join can be split
    tied = cut(tied.select(*key, "root").join(least, "root").select(*key, "first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tag") == F.col("first.tag"))
    return prints.join(tied, key).select("doc_id", "tag", *shape.columns, F.col("first.doc_id").alias("component_id"), stays.alias("stays"))


def of_heads(nodes: DataFrame, links: DataFrame, shape: Shape) -> DataFrame:
    """Links of fingerprints as links ``a, b, d`` of the first node of each."""
    head = cut(nodes.groupBy(*shape.columns).agg(F.min("node").alias("node")))
    a = head.select(*shape.columns, F.col("node").alias("a"))
    b = head.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(shape.columns)], F.col("node").alias("b"))
    return links.join(a, shape.columns).join(b, [f"g{i}" for i in range(shape.words)]).select("a", "b", "d")


class Sets:
    """Shingle sets of some texts, side by side, and the parts that they form. Texts of one ``part`` belong together from the start."""

    def __init__(self, grams: np.ndarray, size: np.ndarray, part: np.ndarray):
        self.size, self.start = size, np.cumsum(size) - size
        _, self.gram = np.unique(grams, return_inverse=True)
        self.width = int(self.gram.max(initial=0)) + 1
        self.held = np.repeat(np.arange(len(size)), size) * self.width + self.gram  # in order, as the sets are
        _, first, of = np.unique(part, return_index=True, return_inverse=True)
        self.root = first[of]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shared shingles of each pair: those of the smaller set that the other one holds."""
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        n = self.size[a]
        pair = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(pair)) + np.repeat(self.start[a] - (np.cumsum(n) - n), n)
        wanted = b[pair] * self.width + self.gram[at]
        place = np.minimum(np.searchsorted(self.held, wanted), len(self.held) - 1)
        return np.bincount(pair[self.held[place] == wanted], minlength=len(a))

    def links(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Places of the pairs that are alike and join two parts. Pairs are taken in order; those inside a part are passed over."""
        found, at = [], 0
        while at < len(a):
            part = np.arange(at, min(len(a), at + BLOCK))
            some = np.cumsum(np.minimum(self.size[a[part]], self.size[b[part]])) <= 8 * BLOCK
            part = part[: max(1, int(some.sum()))]
            at += len(part)
            part = part[self.root[a[part]] != self.root[b[part]]]
            if not len(part):
                continue
            x, y = a[part], b[part]
            both = self.common(x, y)
            part = part[both >= similarity * (self.size[x] + self.size[y] - both) - 1e-9]
            ends = np.stack([self.root[a[part]], self.root[b[part]]], axis=1)
            new = forest(ends)
            found.append(part[new])
            parent = np.arange(len(self.root))
            for p, q in ends[new].tolist():
                while parent[p] != p:
                    p = parent[p]
                while parent[q] != q:
                    q = parent[q]
                parent[max(p, q)] = min(p, q)
            while (up := parent[parent]).tolist() != parent.tolist():
                parent = up
            self.root = parent[self.root]
        return np.concatenate([*found, np.zeros(0, np.int64)])


def alike(pairs: DataFrame, texts: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b, d) that are similar enough, without the redundant ones.

    ``texts`` has ``node, team, block, grams``: texts of a group are dealt to blocks of bounded size, and a task gets the
    pairs of two blocks and one copy of each set that they name. ``parts`` (node, root) says what belongs together already.
    """
    place = lambda x: texts.select(F.col("node").alias(x), F.col("team").alias(f"team_{x}"), F.col("block").alias(f"block_{x}"))
    unit = ["team", "i", "j"]
    dealt = pairs.join(place("a"), "a").join(place("b"), "b")
    dealt = cut(dealt.select(F.col("team_a").alias("team"), F.least("block_a", "block_b").alias("i"), F.greatest("block_a", "block_b").alias("j"), "a", "b", "d"))
    wanted = dealt.select(*unit, F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = wanted.join(texts.select("node", "grams"), "node").join(parts.select("node", "root"), "node")
    wanted = wanted.select(*[F.col(c).alias(f"of_{c}") for c in unit], "node", "root", "grams")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        node = right.column("node").to_numpy()
        order = np.argsort(node)
        node, grams = node[order], right.column("grams").combine_chunks().take(pa.array(order))
        a, b, d = (left.column(c).to_numpy() for c in "abd")
        turn = np.lexsort((b, a, d))
        a, b, d = a[turn], b[turn], d[turn]
        sets = Sets(grams.flatten().to_numpy(), pa.compute.list_value_length(grams).to_numpy(), right.column("root").to_numpy()[order])
        new = sets.links(np.searchsorted(node, a), np.searchsorted(node, b), similarity)
        return pa.table({"a": a[new], "b": b[new]})

    return dealt.groupBy(*unit).cogroup(wanted.groupBy(*[f"of_{c}" for c in unit])).applyInArrow(compare, "a long, b long")


def meetings(members: DataFrame, parts: DataFrame, shape: Shape, max_bucket: int, words: int | None = None) -> DataFrame:
    """Members (group, node, n, fingerprints) of groups that fall into several ``parts``, in units that hold every pair of parts that meets in a bucket (of the first ``words`` words).

    A unit ``t, k, i, j`` is a bucket ``t, k``, or a group ``k`` of few texts, where t is -1; ``i < j`` are two blocks of what is too large for one task.
    Rows are sorted by unit.
    """
    rows = members.select("group", "node", "n", *shape.columns).join(parts.select("node", "root"), "node")
    split = rows.groupBy("group").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("texts")).where("least != most")
    few = F.when(F.col("texts") <= FEW_TEXTS, F.ceil(F.col("texts") / min(FEW_BLOCK, max_bucket))).otherwise(0).cast("int")
    rows = cut(rows.join(cut(split.select("group", few.alias("few"))), "group"))
    rest = ["group", "node", "n", "root", *shape.columns]
    together = rows.where("few > 0").select(F.lit(-1).alias("t"), F.col("group").alias("k"), F.col("few").alias("blocks"), *rest)
    each = rows.where("few = 0").select(*rest, F.inline(shape.tables(words)))
    sizes = each.groupBy("t", "k").agg(F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most")).where("least != most")
    sizes = cut(sizes.select("t", "k", F.when(F.col("size") > max_bucket, F.ceil(2 * F.col("size") / max_bucket)).otherwise(1).cast("int").alias("blocks")))
    whole = each.join(sizes.where("blocks = 1"), ["t", "k"]).select("t", "k", "blocks", *rest).unionByName(together.where("blocks = 1"))
    whole = whole.select("t", "k", *[F.lit(0).alias(c) for c in ("i", "j", "block")], *rest)
    cut_up = each.join(sizes.where("blocks > 1"), ["t", "k"]).select("t", "k", "blocks", *rest).unionByName(together.where("blocks > 1"))
    cut_up = cut_up.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = whole.unionByName(cut_up.select("t", "k", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", *rest))
    return each.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "node")


def meeting_pairs(shape: Shape, similarity: float, named: bool, words: int | None = None):
    """Reads rows of ``meetings``. Gives the pairs of different parts that the masks (of the first ``words`` words) propose, each once: ``a, b, d`` if ``named``, else their number ``group, m``."""
    tables = sum(words is None or w < words for w, _ in shape.masks)

    def pairs(unit: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        t, k, i, j, block, _, _, n, root = unit[:9]
        fp = unit[9:]

        def proposed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ok = (root[a] != root[b]) & ((i[a] == j[a]) | (block[a] != block[b])) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9)
            a, b = a[ok], b[ok]
            d = apart(fp, a, b)
            ok = d <= shape.reach
            a, b, d = a[ok], b[ok], d[ok]
            met = shape.first_table([f[a] ^ f[b] for f in fp])
            ok = np.where(t[a] < 0, (met >= 0) & (met < tables), met == t[a])
            return a[ok], b[ok], d[ok]

        first = _starts(t, k, i, j)
        size = np.diff(np.append(first, len(t)))
        few = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
        last = np.repeat(first + size, size)
        for step in range(1, min(SMALL, int(size[size <= SMALL].max(initial=1)))):
            a = few[few + step < last[few]]
            if len(a):
                yield proposed(a, a + step)
        for at, m in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            strip = max(1, BLOCK // m)
            for x in range(at, at + m - 1, strip):
                a, b = (y.ravel() for y in np.mgrid[x : min(x + strip, at + m), x + 1 : at + m])
                yield proposed(a[a < b], b[a < b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in whole_units(batches, 4):
            unit[9:] = [f.view(np.uint64) for f in unit[9:]]
            group, node, found, held = unit[5], unit[6], [], 0
            for some in itertools.chain(pairs(unit), [None]):
                if some is not None and len(some[0]):
                    found.append(some)
                    held += len(some[0])
                if found and (some is None or held > BLOCK):
                    a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
                    found, held = [], 0
                    if named:
                        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(d.astype(np.int32))], names=["a", "b", "d"])
                    else:
                        names, m = np.unique(group[a], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(m)], names=["group", "m"])

    return run


def whole_units(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that no unit (equal first ``keys`` columns) is spread over two."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        last = int(_starts(*columns[:keys])[-1])
        if last:
            yield [c[:last] for c in columns]
        held = [c[last:] for c in columns]
    if held is not None:
        yield held


def links_between_parts(members: DataFrame, texts: DataFrame, parts: DataFrame, shape: Shape, similarity: float) -> DataFrame:
    """Links ``a, b`` of dense groups: two blocks of a group meet in a task with their shingle sets.

    ``members`` has ``group, team, block, blocks, node`` and fingerprints. All pairs of different parts that the masks propose are compared inside the
    task, the nearer ones first; only links leave it.
    """
    rows = members.join(parts.select("node", "root"), "node").join(texts.select("node", "grams"), "node")
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("team", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "group", "block", "node", "root", *shape.columns, "grams")

    def compare(table: pa.Table) -> pa.Table:
        group, node = (table.column(c).to_numpy() for c in ("group", "node"))
        order = np.lexsort((node, group))
        group, node = group[order], node[order]
        block, root, i, j = (table.column(c).to_numpy()[order] for c in ("block", "root", "i", "j"))
        fp = [table.column(c).to_numpy()[order].view(np.uint64) for c in shape.columns]
        grams = table.column("grams").combine_chunks().take(pa.array(order))
        size = pa.compute.list_value_length(grams).to_numpy()
        first = _starts(group)
        last = np.repeat(np.append(first[1:], len(group)), np.diff(np.append(first, len(group))))
        found: list[np.ndarray] = []
        for x in range(len(node)):
            y = np.arange(x + 1, last[x])
            d = apart(fp, y, x)
            ok = (d <= shape.reach) & (root[y] != root[x]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9)
            if i[x] != j[x]:  # pairs inside a block are compared where the block meets itself
                ok &= block[y] != block[x]
            if ok.any():
                found.append(np.stack([np.full(ok.sum(), x), y[ok], d[ok]], axis=1).astype(np.int32))
        pairs = np.concatenate([*found, np.zeros((0, 3), np.int32)])
        pairs = pairs[shape.first_table([f[pairs[:, 0]] ^ f[pairs[:, 1]] for f in fp]) >= 0]
        pairs = pairs[np.argsort(pairs[:, 2], kind="stable")]
        a, b = pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)
        new = Sets(grams.flatten().to_numpy(), size, root).links(a, b, similarity)
        return pa.table({"a": node[a[new]], "b": node[b[new]]})

    return rows.groupBy("team", "i", "j").applyInArrow(compare, "a long, b long")


def _row_key(doc_id: Column, tag: Column) -> list[Column]:
    """Equality of these is equality of id and text, nulls included."""
    return [doc_id.isNull().alias("none"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), tag.alias("tag")]


def similar_links(docs: DataFrame, nodes: DataFrame, shingle: int, shape: Shape, similarity: float, max_bucket: int) -> DataFrame:
    """Links ``a, b`` of nodes that connect all whose texts are similar enough and whose fingerprints propose it."""
    nodes = cut(nodes.select("node", *[F.col(f"first.{c}").alias(c) for c in ("none", "doc_id", "tag", *shape.columns, "n")]))
    proposed = of_heads(nodes, near_links(nodes.select(*shape.columns).distinct(), shape, max_bucket), shape)
    head = nodes.groupBy(*shape.columns).agg(F.min("node").alias("b"))
    proposed = cut(proposed.unionByName(nodes.join(head, shape.columns).where("node != b").select(F.col("node").alias("a"), "b", F.lit(0).alias("d"))))
    groups = cut(components(proposed))
    groups = cut(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "group"))  # with the roots themselves

    sizes = cut(groups.join(nodes.select("node", "n"), "node").groupBy("group").agg(F.sum(F.col("n") + 1).alias("grams"), F.count("*").alias("texts")))
    blocks = F.ceil(F.greatest(F.col("grams") / SET_GRAMS, F.col("texts") / min(SET_TEXTS, max_bucket))).cast("int")
    sizes = sizes.withColumn("blocks", blocks)
    teams = -(-(sizes.where("blocks = 1").agg(F.sum("grams")).first()[0] or 0) // SET_GRAMS) or 1
    team = F.when(F.col("blocks") > 1, F.col("group")).otherwise(-1 - F.pmod(F.xxhash64("group"), F.lit(teams)))  # small groups share a task
    members = groups.join(sizes.select("group", "blocks"), "group").select("group", "node", "blocks", team.alias("team"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    members = cut(members.join(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_set(shingle_hashes(t.as_py(), shingle, shape.words > 1)) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.list_(pa.int64()))], names=["node", "team", "block", "grams"])

    rows = docs.select(*_row_key(F.col("doc_id"), F.xxhash64("text")), "text").join(members.select("node", "team", "block", *_row_key(F.col("doc_id"), F.col("tag"))), ["none", "id", "tag"])
    texts = cut(rows.select("node", "team", "block", "text").mapInArrow(run, "node long, team long, block int, grams array<long>").dropDuplicates(["node"]))

    found = cut(alike(proposed, texts, members.withColumn("root", F.col("node")), similarity))
    parts = cut(members.select("node").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node")))
    met = meetings(members, parts, shape, max_bucket, 1).mapInArrow(meeting_pairs(shape, similarity, False, 1), "group long, m long")
    met = met.groupBy("group").agg(F.sum("m").alias("m")).join(sizes.select("group", "texts"), "group")
    whole = cut(met.where(DENSE * F.col("m") >= F.col("texts") * F.col("texts")).select("group"))
    dense = links_between_parts(members.join(whole, "group"), texts, parts, shape, similarity)
    named = meetings(members.join(whole, "group", "left_anti"), parts, shape, max_bucket).mapInArrow(meeting_pairs(shape, similarity, True), "a long, b long, d int")
    return cut(found.unionByName(dense).unionByName(alike(named, texts, parts, similarity)))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, shape: Shape = WIDE) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id, rows without an id last.

    Repeated rows (one id and one text) are one document. All columns come through, whatever their names.
    """
    gone = near_duplicates(docs, shingle, shape, similarity).where("NOT stays").select(*_row_key(F.col("doc_id"), F.col("tag"))).distinct()
    row = docs.select(F.struct("*").alias("row"))
    rows = row.select(*_row_key(F.col("row.doc_id"), F.xxhash64("row.text")), "row")
    return rows.join(gone, ["none", "id", "tag"], "left_anti").dropDuplicates(["none", "id", "tag"]).select("row.*")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, shape=PLAIN)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLES: dict[str, str] = {}
