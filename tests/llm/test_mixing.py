import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riffle.llm.mixing import WORD, mix_copies, mixed_documents, source_targets, word_count
from riffle.session import table


def slow_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += left * w[s] / total
        left = sum(max(0, target[s] - 2 * sizes[s]) for s in free)
        full = {s for s in free if target[s] >= 2 * sizes[s]}
        for s in full:
            target[s] = 2.0 * sizes[s]
        free -= full
    return target


def slow_size(t):
    return len(re.findall(WORD, t or ""))


def check(rows, got):
    sizes, docs, taken, biggest = Counter(), Counter(), defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += slow_size(t)
        docs[(i, s, slow_size(t))] += 1
        biggest[s] = max(biggest[s], slow_size(t))
    want = slow_targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == docs
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, x in taken.items():
        assert abs(x - want[s]) <= biggest[s] + 1e-6


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_targets_and_words_taken(spark, fan):
    rows = [(i, "w " * (1 + i * 7919 % 97), f"s{i % 3}" if i % 4 else "hot") for i in range(600)]
    rows += [(1000 + i, t, s) for i, (t, s) in enumerate([(None, "hot"), ("", None), ("a b", None), ("x", "é"), ("x y\x0bz", "ÿ"), ("  ", "only blank")])]
    rows += [(5, "w " * 9, "hot")] * 4 + [(None, "null id", "hot")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, target int")
    got = mix_copies(docs, fan=fan).collect()
    check(rows, got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_copies(docs.repartition(3), fan=fan).collect()), key=repr)
    mixed = mixed_documents(docs, fan=fan)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got) and mixed.select(F.sum(word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)


def test_expected_copies_are_kept(spark):
    """Over many small mixes the mean number of copies is the target's part, for short and long documents alike."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('s', lpad(id % 300, 3, '0')) AS source", "repeat('w ', cast(1 + id div 300 % 10 AS int)) AS text")
    out = mix_copies(docs).groupBy("size").agg(F.avg(F.col("copies") - F.col("target") / F.col("source_size")).alias("off")).collect()
    assert len(out) == 10 and all(abs(r.off) < 0.03 for r in out)


def test_no_words_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in mix_copies(docs).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    assert mix_copies(docs.where(F.lit(False))).count() == 0


def test_on_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], mix_copies(docs).collect())
    assert source_targets(docs.select("source", word_count(F.col("text")).alias("size"))).count() == docs.select("source").distinct().count()


def test_names_that_clash_and_null_ids(spark):
    rows = [(None, "a b c", None), (None, "a b c", None), (None, "d e", "x"), (1, "f g h", "x"), (2, None, "x")]
    docs = spark.createDataFrame([(*r, i, "c", "t", "n", "r") for i, r in enumerate(rows)], "doc_id long, text string, source string, __size int, copies string, taken string, nth string, `row.x` string")
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = mix_copies(docs).collect()
    kept = out.collect()
    assert len(kept) == sum(r.copies for r in got) and {r["__size"] for r in kept} <= set(range(5)) and all(tuple(r)[4:] == ("c", "t", "n", "r") for r in kept)


def test_a_third_of_the_rows_under_one_id_or_alike(spark):
    from riffle.llm.mixing import FAN, ROW

    same_id = spark.range(20_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "concat('text ', id) AS text", "'a' AS source")
    alike = spark.range(20_000).selectExpr("5L AS doc_id", "'the same text' AS text", "'a' AS source")
    rest = spark.range(20_000).selectExpr("id + 100 AS doc_id", "concat('other ', id) AS text", "'b' AS source")
    docs = same_id.unionByName(alike).unionByName(rest)
    out = mix_copies(docs).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert {r.source: r.n for r in out} == {"a": 40_000, "b": 20_000} and all(abs(r.taken - r.target) <= 3 for r in out)
    # blocks are dealt by a hash of the whole row, so none is much beyond FAN
    rows = docs.selectExpr("doc_id", "xxhash64(text) AS mark", "row_number() OVER (PARTITION BY doc_id, text ORDER BY text) AS nth", "3L AS size")
    sizes = rows.groupBy(F.pmod(F.xxhash64(F.xxhash64(F.lit(20), F.lit(0), *ROW), F.lit(20)), F.lit(60_000 // FAN))).count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * FAN


def test_the_query_against_brute_force(spark):
    from riffle.llm.mixing import op5_pivotal_mixing

    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source").collect()]
    check(rows, op5_pivotal_mixing(spark, "/root/testdata/sf0.01").collect())
