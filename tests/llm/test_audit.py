import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riffle.llm import audit
from tests.oracle import same

SCHEMA = "doc_id long, text string, lang string, part string, same string, A string"
ids = st.lists(st.integers(0, 4000), max_size=900).map(lambda x: np.unique(np.array(x, np.int64)))


@settings(max_examples=60, deadline=None)
@given(ids, ids)
def test_galloping_merges_are_set_operations(a, b):
    assert audit.union(a, b).tolist() == sorted({*a.tolist()} | {*b.tolist()})
    assert audit.minus(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
    assert (audit.gallop(a, b) == np.searchsorted(b, a)).all()


def brute(rows, labels):
    """Documents are (id, text, lang); every order is applied to every document."""
    docs = []
    for at, (doc_id, text, lang) in enumerate(rows):
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = doc_id is not None and any(t == (u or "") and d is not None and d < doc_id for d, u, _ in rows)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        docs.append((lang or "", fails, any(d == doc_id is not None and q == 1 for d, q, _ in labels), any(d == doc_id is not None and x == 1 for d, _, x in labels)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                total[f] += len(gone)
                fails = [d for d in own if d[1][f]]
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(sum(d[1].values()) == 1 for d in fails), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(audit.with_labels(audit.with_repeats(audit.failures(docs)), known), "ABCDE").collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}, len(found)


def test_against_every_order_applied_to_every_document(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE", 3)  # many ranges
    words = [f"w{i}" for i in range(130)]
    long, shout = " ".join(words), " ".join(w.upper() + "X" for w in words)
    rows = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, "a b a a", "en"), (4, None, "en"), (5, "", None), (None, "", "en"), (None, long, None)]
    rows += [(i, x, lang) for i, (x, lang) in enumerate([(long + " $", "de"), (shout, "de"), ("a \x0b a b " + "a " * 200, "de"), (long * 400, "fr"), (shout + "|", None), (shout + "|", "en"), ("é" * 50 + "ABCDEF", "en")] * 3, 10)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (None, 1, 1), (4, 0, 0), (12, 1, 1), (99, 1, 1)]
    found, n = run(spark, rows, labels)
    assert n == len(found) == 600 * 4
    assert found == brute(rows, labels)


def test_empty_tables(spark):
    assert run(spark, [], [])[1] == 0
    assert run(spark, [(1, "a", None)], [])[0][("", "ABCDE", 1)] == (0, 1, 0, 1, 0, 0, 120)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_its_sql(spark, sf):
    n, extra, missing = same(spark, audit.QUERIES["op12_filter_interaction_audit"], audit.ORACLES["op12_filter_interaction_audit"], f"/root/testdata/{sf}")
    assert n and not extra and not missing
