from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from riffle.llm import bpe, simhash
from riffle.session import table

SF = "/root/testdata/sf0.01"


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= kept, name
        kept = set(ids)
        if name == "encoding":
            continue
        assert docs.columns == columns, name
        if name == "quality":
            bad = {r.doc_id for r in table(spark, SF, "labels").where("quality = 0").collect()}
            good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
            assert len(bad & kept) < 0.3 * len(bad) and len(good & kept) > 0.98 * len(good)
        if name == "line_dedup":
            assert docs.where("n_chars != length(text)").count() == 0
        if name == "near_dedup":
            assert docs.select("text").distinct().count() == docs.count()
        if name == "mixing":
            texts = {r.doc_id: r.text for r in docs.collect()}
            copies = Counter(ids)
            assert set(copies.values()) <= {1, 2} and 2 in copies.values()
    model = bpe.load(bpe._file()).library
    rows = docs.collect()
    assert Counter(r.doc_id for r in rows) == copies
    assert all(r.ids == model.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(4)
    word = [f"w{i}" for i in range(4000)]
    base = [[word[i] for i in rng.integers(0, 4000, n)] for n in rng.integers(120, 600, 60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    planted = {}
    for i, w in enumerate(base[:40]):
        v = list(w)
        for at in rng.choice(len(v), max(1, len(v) // 200), replace=False):
            v[at] = "changed"
        rows.append((100 + i, " ".join(v)))
        planted[100 + i] = i
    rows += [(200, rows[0][1]), (201, rows[0][1].upper()), (7, rows[7][1]), (None, "no id"), (300, None), (301, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tag int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert all(ids[i] == 1 for i in range(60)) and not ids[200] and not ids[201] and ids[None] == 1 and ids[300] + ids[301] == 1
    near = [i for i, j in planted.items() if jaccard(dict(rows)[i], dict(rows)[j]) >= 0.9]
    assert len(near) > 30 and sum(ids[i] for i in near) <= 0.1 * len(near)
    assert simhash.one_of_each(docs.where(F.lit(False))).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


def test_encoding_decodes_too(spark):
    texts = ["Two words", "", None, "caf\u00e9 \u4e16\u754c\n\n x"]
    rows = corpus_pipeline.encoded(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SF).collect()
    model = bpe.load(bpe._file()).library
    want = {i: model.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in rows} == want
    assert {r.doc_id: r.text for r in rows} == {i: model.decode(ids, skip_special_tokens=False) for i, ids in want.items()}
