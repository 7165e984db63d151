import zlib

import numpy as np
from pyspark.sql import functions as F

from riffle.llm.quality import MEASURES, fit, keep_good, learn, measure, op9_additive_quality, scored
from riffle.session import table
from tests.oracle import duck

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op9_additive_quality(spark, SF).collect()}
    assert len(got) == duck(SF).execute("SELECT count(*) FROM documents").fetchall()[0][0]
    labels = [(i, q) for i, q in duck(SF).execute("SELECT doc_id, quality FROM labels").fetchall() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in labels) and sum(r.held_out for r in got.values()) < 300
    good = [got[i].score for i, q in labels if q == 1]
    bad = [got[i].score for i, q in labels if q == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97 and np.mean([s >= 0.3 for s in good]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_learns_additive_and_pair_effects():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = learn(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.93
    assert {(a, b) for a, b, _ in model.pairs} >= {(1, 0)}
    assert np.ptp(learn(x, np.ones(4000)).score(x)) == 0


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (3, "word " * 30_000), (4, "Ü!| 3 a a"), (None, "x")]
    docs = spark.createDataFrame([(*r, 0.5, 7) for r in rows], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (4, 1), (4, 0), (9, 3), (None, 1)], "doc_id long, quality int")
    model = fit(docs, labels)
    out = scored(docs, model, "s").collect()
    assert len(out) == len(rows) and all(0 <= r.s <= 1 for r in out) and len({r.s for r in out if r.doc_id == 3}) == 1
    assert keep_good(docs, labels).columns == docs.columns
    none = fit(docs.where(F.lit(False)), labels.where(F.lit(False)))
    assert {r.s for r in scored(docs, none, "s").collect()} == {0.5} and scored(docs.where(F.lit(False)), none).count() == 0
    assert len(measure(None)) == len(MEASURES) and all(np.isfinite(measure("a\n" * 100_000)))


def test_same_model_for_any_order(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    a, b = fit(docs, labels), fit(docs.repartition(7), labels.repartition(5))
    assert all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))
