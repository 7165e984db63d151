import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.llm import topk
from tests.oracle import same

KIND = "vec_id long, embedding array<double>, row string, x string, length string, reach string, level string"


def brute(rows, every, k=5, scale=256):
    """Rows are (id, vector or None); repeated rows count once."""
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    fine = sorted(fine)
    q = [[int(np.floor(scale * c)) for c in v] for _, v in fine]
    out = []
    for a, (i, _) in enumerate(fine):
        if i % every == 0:
            all_of = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), fine[b][0]) for b in range(len(fine)) if b != a)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(all_of[:k], 1)]
    return sorted(out)


def run(spark, rows, every=1, k=5, parts=3):
    df = spark.createDataFrame([(i, v, "a", "b", "c", "d", "e") for i, v in rows], KIND).repartition(parts)
    return sorted(tuple(r) for r in topk.top_products(df, F.col("vec_id") % every == 0, k).collect())


def small(monkeypatch, seed=8):
    for name, value in {"SEED": seed, "BUCKET": 16, "SHARD": 2, "GROUP": 8, "TOGETHER": 4, "SHARE": 0.9}.items():
        monkeypatch.setattr(topk, name, value)


def clustered(n, dim, rng, spread=0.05):
    centres = rng.standard_normal((n // 12, dim))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, dim))
    return x * np.exp(rng.standard_normal((n, 1)))  # lengths of many sizes


def test_against_all_products(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(13)
    x = clustered(300, 6, rng)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (400, [0.0] * 6), (401, [0.0] * 6), (402, None), (None, [1.0] * 6), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, [float("nan")] * 6), (405, [float("inf")] + [0.0] * 5)]
    rows += [(500 + i, rows[3][1]) for i in range(150)]  # one vector of a third of all rows
    assert run(spark, rows, 3) == brute(rows, 3)


def test_coordinate_lists_are_used_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    x = clustered(600, 4, rng, 0.01)
    x = np.floor(4096 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int32)
    length = np.sqrt((x.astype(float) ** 2).sum(1))
    order = np.argsort(-length)
    x, length = x[order], length[order]
    calls = []
    plain = topk.Bucket.candidates
    monkeypatch.setattr(topk.Bucket, "candidates", lambda *a: calls.append(plain(*a)) or calls[-1])
    row = np.arange(600)
    score = topk.products(x, x)
    score[row, row] = topk.NONE
    want = np.sort(score, axis=1)[:, ::-1][:, :5]
    asked = topk.Asked(row, row, x, length, topk.Best(want[:, 4].copy(), 5))
    for at in range(0, 600, 200):
        part = slice(at, at + 200)
        topk.retrieve(topk.Bucket(row[part], row[part], x[part], length[part]), asked)
    assert (asked.best.score == want).all()
    assert len(calls) > 300 and sum(map(len, calls)) < 20 * len(calls)


def test_large_components_count_as_the_limit(spark, monkeypatch):
    small(monkeypatch)
    top = topk.limit(2)
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [1e5, 3.0]), (3, [1e12, -7.0])]
    cut = lambda c: int(max(-top, min(top, np.floor(256 * c))))
    found = {(a, b): s for a, _, b, s in run(spark, rows)}
    for (a, v), (b, w) in [(x, y) for x in rows for y in rows if x != y]:
        assert found[a, b] == sum(cut(p) * cut(q) for p, q in zip(v, w, strict=True))


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0]), (2, [3.0, -4.0])]])
def test_few_rows(spark, rows):
    assert run(spark, rows) == brute([r for r in rows if r[1] and len(r[1]) == 2], 1)


def test_query_equals_its_sql(spark):
    n, extra, missing = same(spark, topk.QUERIES["op13_norm_bucket_topk"], topk.ORACLES["op13_norm_bucket_topk"], "/root/testdata/sf0.001")
    assert n == 50 and not extra and not missing
