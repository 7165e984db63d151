"""Interaction audit of filters: what each filter removes, in every order in which they may be applied.

Every document that fails a filter stands in a posting list: the ascending row numbers of one part of the corpus, one
filter and one range of rows. What an order of filters does follows from unions and differences of these lists. Ranges
share no rows, so each range is merged alone, by galloping through the sorted lists, and the sizes add up. A range holds
``1 << RANGE`` rows at most, whatever part they belong to, so a part with a third of all rows is spread over many ranges.

Defined results: a null text is an empty text, a null part an empty string; an empty text has no words and fails A alone
(and E, if it is not the first); repeated rows are documents of their own, none of which has a smaller id than the
others, so ties keep each other; a row without an id is smaller than no other and has no smaller one; several labels of
one id count as the larger one; ids without a label are neither good nor toxic; an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.session import cut, table

SPACE = " \t\n\x0b\x0c\r"
#: A posting list covers so many rows, as a power of two.
RANGE = 14
#: Needles that gallop together.
STRETCH = 256
GOOD, TOXIC = "good", "toxic"


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, A, B, C, D, same``: whether each document fails the four filters that look at it alone, and the SHA-256 of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    bare = F.btrim("text", F.lit(SPACE))
    rows = rows.select("*", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t-\r]+")).alias("words"))
    return rows.select(
        "doc_id",
        "part",
        (F.size("words") < 100).alias("A"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 80 * F.size("words").cast("long")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.length("text").cast("long")).alias("C"),
        F.rlike("text", F.lit("[#$%&*|]")).alias("D"),
        F.unhex(F.sha2("text", 256)).alias("same"),
    )


def with_repeats(rows: DataFrame) -> DataFrame:
    """``E`` in place of ``same``: whether any smaller doc_id of the whole table has the same text."""
    rows = cut(rows)
    least = rows.groupBy("same").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("same", "least")
    joined = rows.join(cut(least), "same", "left")  # both kept as tables, so that a common text's part of the join can be split
    return joined.select(*[c for c in rows.columns if c != "same"], F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``."""
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias(GOOD), is_one("toxic").alias(TOXIC))
    joined = cut(rows).join(cut(known.where(f"{GOOD} OR {TOXIC}")), "doc_id", "left")
    return joined.select(*rows.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in (GOOD, TOXIC)])


def postings(rows: DataFrame, lists: list[str]) -> DataFrame:
    """``part, range, list, ids``: ascending row numbers for each list, a boolean column of ``rows``."""
    marked = rows.select("part", F.monotonically_increasing_id().alias("row"), F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in lists])).alias("on"))
    each = marked.select("part", F.shiftright("row", RANGE).alias("range"), F.explode("on").alias("list"), "row")
    return each.groupBy("part", "range", "list").agg(F.sort_array(F.collect_list("row")).alias("ids"))


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """Where each needle stands in ``hay``, both ascending.

    A stretch of needles starts where the last one ended; steps double until they pass it, and binary search does the rest.
    """
    out, at = np.empty(len(needles), np.int64), 0
    for i in range(0, len(needles), STRETCH):
        some = needles[i : i + STRETCH]
        step = STRETCH
        while at + step < len(hay) and hay[at + step] < some[-1]:
            step *= 2
        out[i : i + STRETCH] = at + np.searchsorted(hay[at : at + step + 1], some)
        at = int(out[min(i + STRETCH, len(needles)) - 1])
    return out


def held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` stand in ``b``; the shorter list gallops through the longer one."""
    out = np.zeros(len(a), bool)
    if len(a) and len(b):
        if len(a) <= len(b):
            at = np.minimum(gallop(a, b), len(b) - 1)
            out[:] = b[at] == a
        else:
            at = np.minimum(gallop(b, a), len(a) - 1)
            out[at[a[at] == b]] = True
    return out


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[~held(a, b)]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    new = minus(b, a)
    return np.insert(a, gallop(new, a), new)


def set_sizes(lists: dict[str, np.ndarray], filters: str) -> list[tuple[str, int, int, int, int, int]]:
    """``(filter, before, removed, good_lost, toxic_lost, gone)`` for each filter and each set ``before`` (bits) of the others applied ahead of it.

    Each union and difference takes the result for one filter fewer and merges one more list with it.
    """
    empty = np.zeros(0, np.int64)
    own = [lists.get(f, empty) for f in filters]
    unions = [empty]
    for mask in range(1, 1 << len(own)):
        low = (mask & -mask).bit_length() - 1
        unions.append(union(unions[mask & (mask - 1)], own[low]))
    out = []
    for i, f in enumerate(filters):
        left = {0: [own[i], *[own[i][held(own[i], lists.get(k, empty))] for k in (GOOD, TOXIC)]]}
        for mask in range(1 << len(own)):
            if mask >> i & 1:
                continue
            if mask:
                low = (mask & -mask).bit_length() - 1
                left[mask] = [minus(x, own[low]) for x in left[mask & (mask - 1)]]
            out.append((f, mask, *map(len, left[mask]), len(unions[mask | 1 << i])))
    return out


def merged(posted: DataFrame, filters: str) -> DataFrame:
    """``part, filter, before`` and the sizes of ``set_sizes``, summed over all ranges."""
    names = ["filter", "before", "removed", "good_lost", "toxic_lost", "gone"]

    def run(lists: pa.Table) -> pa.Table:
        by_part: dict[str, dict[str, np.ndarray]] = {}
        for part, name, ids in zip(*(lists.column(c) for c in ("part", "list", "ids")), strict=True):
            by_part.setdefault(part.as_py(), {})[name.as_py()] = ids.values.to_numpy()
        rows = [(part, *sizes) for part, own in by_part.items() for sizes in set_sizes(own, filters)]
        return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["part", *names])

    sizes = posted.groupBy("range").applyInArrow(run, "part string, filter string, before long, removed long, good_lost long, toxic_lost long, gone long")
    return sizes.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in names[2:]])


def audit(rows: DataFrame, filters: str) -> DataFrame:
    """One row for each part, order of the filters and step. ``rows`` has ``part``, a boolean for each filter (one letter each), ``good`` and ``toxic``."""
    rows = cut(rows)
    sizes = cut(merged(cut(postings(rows, [*filters, GOOD, TOXIC])), filters))
    k = F.bit_count("before")
    rest = len(filters) - 1
    orders = reduce(lambda c, n: F.when(k == n, factorial(n) * factorial(rest - n)).otherwise(c), range(len(filters)), F.lit(0))
    of_filter = sizes.groupBy("part", "filter").agg(
        F.sum(F.when(k == 0, F.col("removed"))).alias("fails"), F.sum(F.when(k == rest, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * orders).alias("shapley")
    )
    steps = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    ahead = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bits: list[Column] = [F.when(F.contains(ahead, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(filters)]
    steps = steps.select("part", "n", "filter_order", "step", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"), reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long").alias("before"))
    all_of = steps.join(sizes, ["part", "filter", "before"], "left").join(of_filter, ["part", "filter"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return all_of.select(
        "part", "filter_order", "step", (F.col("n") - zero(F.col("gone"))).alias("kept"), zero(F.col("removed")).alias("removed"), (zero(F.col("fails")) - zero(F.col("removed"))).alias("redundant"),
        *[zero(F.col(c)).alias(c) for c in ("unique_fails", "good_lost", "toxic_lost", "shapley")],
    )


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_labels(with_repeats(failures(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "labels"))
    return audit(rows, "ABCDE")


QUERIES = {"op12_filter_interaction_audit": op12_filter_interaction_audit}

ORACLES = {
    "op12_filter_interaction_audit": r"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
facts AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
  [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM texts LEFT JOIN labels USING (doc_id)),
groups AS (SELECT part, good, toxic, fails, count(*) AS n FROM facts GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, list_transform(string_split(substring(filter_order, 1, step - 1), ''), lambda f: ascii(f) - 64) AS ahead, ascii(substring(filter_order, step, 1)) - 64 AS f FROM orders, unnest(range(1, 6)) s(step)),
seen AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS fails, step > 1 AND list_bool_or(list_transform(ahead, lambda i: fails[i])) AS before, NOT list_bool_or(list_transform(range(1, 6), lambda i: i <> f AND fails[i])) AS alone FROM groups, steps),
sizes AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT fails AND NOT before) AS kept, sum(n) FILTER (fails AND NOT before) AS removed, sum(n) FILTER (fails AND before) AS redundant, sum(n) FILTER (fails AND alone) AS unique_fails,
  sum(n) FILTER (fails AND NOT before AND good) AS good_lost, sum(n) FILTER (fails AND NOT before AND toxic) AS toxic_lost FROM seen GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM sizes"""
}
