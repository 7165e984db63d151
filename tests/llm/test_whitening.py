import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.llm import whitening as w

KIND = "vec_id long, embedding array<double>, x string, c string, deviation string, part string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], KIND).repartition(3)
    return w.whitened(df, **more).collect()


def brute(rows, components=32):
    """Exact numbers of the rows that take part, and whitened values by a full eigendecomposition."""
    fine = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, total = len(fine), [sum(c) for c in zip(*[x for _, x in fine], strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)) for _, x in fine]
    c = np.array([[(n * a - s) / n for a, s in zip(x, total, strict=True)] for _, x in fine])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return fine, n, deviation, c @ u / np.sqrt(e), e / (c**2).sum() * n


def check(found, rows, components=32):
    fine, n, deviation, want, explained = brute(rows, components)
    k = want.shape[1]
    assert len(found) == n * k
    by_id = {}
    for r in found:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    got = np.array([[by_id[i, c + 1][0].whitened for c in range(k)] for i, _ in fine])
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-9
    for (i, _), d in zip(fine, deviation, strict=True):
        assert {(r.n, r.deviation) for r in by_id[i, 1]} == {(n, d)}
    assert np.allclose([by_id[fine[0][0], c + 1][0].explained for c in range(k)], explained, rtol=1e-10)
    assert max(r.identity_error for r in found) < 1e-10 and len({r.identity_error for r in found}) == 1


def test_against_a_full_decomposition(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 40)) * np.exp(-np.arange(40) / 15)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5, rows[5][1])] * 2 + [(None, rows[6][1])] + [(1000 + i, rows[9][1]) for i in range(200)]  # repeated rows, no id, a vector of a third of all rows
    rows += [(900, None), (901, [float("nan")] * 40), (902, [None] + [0.0] * 39), (903, [float("-inf")] * 40)]
    check(run(spark, rows), rows)
    check(run(spark, rows, components=3), rows, 3)


def test_search_needs_few_passes_and_reaches_double_precision():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 200)) * np.exp(-np.arange(200) / 30)
    v = x.T @ x / 500
    passes = []
    values, vectors = w.leading_pairs(lambda b: passes.append(b.shape[1]) or v @ b, 200, 10)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:10]).max() < 1e-12 * values[0]
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(10)).max() < 1e-13
    assert len(passes) < 60


@pytest.mark.parametrize("kind", ["equal", "flat", "double"])
def test_equal_and_missing_eigenvalues(kind):
    v = {"equal": np.eye(30), "flat": np.diag([3.0, 2.0] + [0.0] * 28), "double": np.diag([2.0, 2.0, 2.0] + [1.0] * 27)}[kind]
    values, vectors = w.leading_pairs(lambda b: v @ b, 30, 5)
    assert np.allclose(values, np.sort(np.diag(v))[::-1][:5], atol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 and np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-12


def test_minres_solves_symmetric_indefinite_systems():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((12, 12))
    a, b = a + a.T, rng.standard_normal((12, 4))
    b[:, 2] = 0
    assert np.abs(a @ w.minres(lambda t: a @ t, b, 14) - b).max() < 1e-8


def test_components_without_variance_are_not_returned(spark):
    rows = [(i, [float(i % 3), float(i % 3) * 2, 7.0]) for i in range(30)]
    found = run(spark, rows)
    assert {r.component for r in found} == {1} and len(found) == 30
    check(found, rows, 1)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_too_few_rows(spark, rows):
    assert run(spark, rows) == []


def test_large_entries_keep_exact_deviations(spark):
    rows = [(0, [3e8, 0.0]), (1, [-1e8, 1.0]), (2, [0.5, 1e300]), (3, [7.0, -2.0])]
    found = {r.vec_id: r.deviation for r in run(spark, rows)}
    x = [[max(-w.LIMIT, min(w.LIMIT, math.floor(max(-1e18, min(1e18, 64 * c))))) + 1_000_000 for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((4 * a - s) ** 2 for a, s in zip(v, total, strict=True)) for v in x]
    assert [found[i] for i in range(4)] == [d if d < 1 << 63 else None for d in want]


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>")).collect()
    check(w.op11_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), [(r[0], r[1]) for r in rows])
