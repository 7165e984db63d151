import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.llm import ann
from riffle.llm.ann import Hashing, nearest_neighbours, op8_multiprobe_neighbours
from tests.oracle import duck


def slow(ids, x, queries, n=10):
    out = {}
    for q in queries:
        i = ids.index(q)
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[q] = sorted((d[j], ids[j]) for j in range(len(ids)) if ids[j] != q)[:n]
    return out


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hits = total = 0
    for q, best in want.items():
        rows = sorted(by.get(q, []))
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [(s, v) for _, s, v in rows] == sorted((s, v) for _, s, v in rows)
        hits += len({v for _, _, v in rows} & {v for _, v in best})
        total += len(best)
    return hits / max(1, total)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_against_brute_force(spark, sf):
    rows = duck(sf).execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).astype(float)
    want = slow(ids, x, [i for i in ids if i % 100 == 0])
    got = op8_multiprobe_neighbours(spark, sf).collect()
    assert recall(got, want) >= 0.9
    exact = {(q, v): d for q, best in want.items() for d, v in best}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)


def test_clusters_copies_and_small_parts(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 12))
    x = np.repeat(centre, 60, axis=0) + 0.05 * rng.standard_normal((360, 12))
    x[200:330] = x[200]
    ids = rng.permutation(1000)[:360].tolist()
    docs = spark.createDataFrame([(i, v.tolist(), 3, 0.5) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, rank int, score double")
    queries = [i for i in ids if i % 5 == 0]
    want = slow(ids, x, queries)
    got = nearest_neighbours(docs, F.col("vec_id") % 5 == 0, fill=16, part=20).collect()
    assert recall(got, want) >= 0.95
    copies = [i for i in queries if ids.index(i) in range(200, 330)]
    by = {q: [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in copies}
    assert copies and all(by[q] == want[q] for q in copies)


def test_probes_come_in_order_of_success():
    x = np.random.default_rng(0).standard_normal((500, 8))
    model = Hashing(x, 5000, 10)
    at = model.steps(x[:1])[0, 0]
    cells = model.probes(at)
    assert (cells[0] == np.floor(at)).all() or len(cells) > 1
    assert len({tuple(c) for c in cells.tolist()}) == len(cells)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest_neighbours(docs, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    r2 = 2**0.5
    assert got == [(0, 1, 8, 0.0), (0, 2, 9, 0.0), (0, 3, 100, r2), (100, 1, 0, r2), (100, 2, 8, r2), (100, 3, 9, r2)]
    assert nearest_neighbours(docs.where(F.lit(False)), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest_neighbours(docs.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_queries_in_thin_regions_get_all_their_rows(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((8, 16)), 75, axis=0) + 0.05 * rng.standard_normal((600, 16))
    x[::60] *= rng.uniform(20, 60, (10, 1))
    docs = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    queries = list(range(0, 600, 20))
    got = nearest_neighbours(docs, F.col("vec_id") % 20 == 0, fill=16, part=64).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in queries}
    assert all(len(v) == 10 for v in by.values())
    want = slow(list(range(600)), x, queries)
    assert all(by[q] == [v for _, v in want[q]] for q in queries if q % 60 == 0)


def test_several_vectors_under_one_id_are_rows_of_their_own(spark):
    rows = [(100, [0.0, 1.0]), (100, [3.0, 1.0]), (100, [3.0, 1.0]), (5, [0.0, 2.0]), (5, [0.0, 4.0]), (6, [3.0, 1.0])]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    lists = sorted((r.score, r.vec_id) for r in got)
    one = [(1.0, 5), (3.0, 6), (3.0, 100), (3.0, 5)]
    two = [(0.0, 6), (3.0, 100), (10**0.5, 5), (18**0.5, 5)]
    assert lists == sorted(one + two) and {r.query_id for r in got} == {100} and sorted(r["rank"] for r in got) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_a_row_repeated_very_often(spark):
    many = spark.range(100_000).selectExpr("7L AS vec_id", "array(1.0D, 2.0D) AS embedding")
    rest = spark.range(2_000).selectExpr("id + 100 AS vec_id", "array(CAST(id % 40 AS double), CAST(id div 40 + 3 AS double)) AS embedding")
    got = nearest_neighbours(many.unionByName(rest), F.col("vec_id") % 1000 == 0).collect()
    assert {r.query_id for r in got} == {1000, 2000} and len(got) == 20


@pytest.mark.parametrize("block", [65_536, 64])
def test_rows_dealt_do_not_grow_with_the_buckets_to_probe(spark, monkeypatch, block):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3_000, 16))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    docs = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    rows = []
    plain = ann.ranked

    def counted(dealt, *rest):
        rows.append(dealt.count())
        return plain(dealt, *rest)

    monkeypatch.setattr(ann, "ranked", counted)
    monkeypatch.setattr(ann, "BLOCK", block, raising=False)
    got = nearest_neighbours(docs, F.col("vec_id") % 20 == 0, fill=2, part=100).collect()
    blocks = -(-150 // block)
    assert len(rows) == 1 and rows[0] <= 2 * 2 * 3_000 * blocks + 150
    queries = list(range(0, 3_000, 20))
    assert recall(got, slow(list(range(3_000)), x, queries)) >= 0.9
    assert len(got) == 1_500


def test_reach_is_the_least_probability_of_the_probes():
    x = np.random.default_rng(0).standard_normal((500, 8))
    model = Hashing(x, 5000, 10)
    at = model.steps(x[:40])
    reach = model.reach(at)
    for i in range(40):
        for t in range(2):
            cells = model.probes(at[i, t])
            logs = model.logs(cells - at[i, t]).sum(axis=1)
            assert np.exp(logs[logs >= reach[i, t]]).sum() >= model.each - 0.05
            assert np.exp(logs[logs < reach[i, t]]).sum() <= 0.05


@pytest.mark.parametrize("power", [70, -70])
def test_scale_changes_no_neighbour(spark, power):
    x = np.random.default_rng(6).standard_normal((400, 24)).astype(np.float32).astype(float)
    lists = []
    for scale, kind in ((1.0, "float"), (1.0, "double"), (2.0**power, "double")):
        docs = spark.createDataFrame(list(enumerate((x * scale).tolist())), f"vec_id long, embedding array<{kind}>")
        lists.append(sorted((r.query_id, r["rank"], r.vec_id, r.score / scale) for r in nearest_neighbours(docs, F.col("vec_id") % 10 == 0, fill=16).collect()))
    assert len(lists[0]) == 400 and lists[0] == lists[1] == lists[2]
