import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from riffle.llm.sharding import cut, first_map, load_map, map_rows, placed, rebalanced, records, slot_sizes, store_map

ROWS = [(i, ("word " * (i % 17)) if i % 5 else None, "s", i) for i in range(400)] + [(7, "word " * 7, "s", 7)] * 3 + [(None, "é" * 50, None, None), (9, "", "s", 0)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")


def shards(spark, n=8, slots=16_384):
    rows = cut(records(docs(spark)))
    sizes = slot_sizes(rows)
    return placed(rows, map_rows(spark, first_map(sizes, n, slots), sizes, 1)).collect(), sizes


def test_sizes_near_equal_and_places_without_gaps(spark):
    got, _ = shards(spark)
    assert len(got) == len(ROWS)
    held, places = defaultdict(int), defaultdict(list)
    for r in got:
        held[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert max(held.values()) - min(held.values()) <= 102
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    assert sorted(map(tuple, shards(spark)[0]), key=repr) == sorted(map(tuple, got), key=repr)


def test_the_map_is_edited_in_versions(spark, tmp_path):
    _, sizes = shards(spark)
    one = first_map(sizes, 8)
    two = rebalanced(one, sizes, 9)
    moved = [s for s in one if one[s] != two[s]]
    load = defaultdict(int)
    for s, x in two.items():
        load[x] += sizes.get(s, (0, 0))[0]
    assert all(two[s] == 8 for s in moved) and max(load.values()) - min(load.values()) <= 160
    three = rebalanced(two, sizes, 8)
    assert all(three[s] == two[s] for s in two if two[s] < 8) and set(three.values()) == set(range(8))
    store_map(map_rows(spark, one, sizes, 1), str(tmp_path / "m"), 1)
    for _ in range(2):  # a write that is tried again leaves one version
        store_map(map_rows(spark, two, sizes, 2), str(tmp_path / "m"), 2)
    assert load_map(spark, str(tmp_path / "m")).count() == len(two)
    assert {r.slot: r.shard for r in load_map(spark, str(tmp_path / "m")).collect()} == two
    assert {r.slot: r.shard for r in load_map(spark, str(tmp_path / "m"), 1).collect()} == one


def test_empty_table(spark):
    rows = cut(records(docs(spark).where(F.lit(False))))
    assert slot_sizes(rows) == {} and placed(rows, map_rows(spark, first_map({}, 8), {}, 1)).count() == 0


def test_the_query_stores_its_map(spark):
    import glob

    from riffle.llm import sharding
    from riffle.session import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/slot-map-*"))
    rows = sharding.op10_virtual_slot_sharding(spark, "/root/testdata/sf0.001").collect()
    (path,) = set(glob.glob(f"{folder}/slot-map-*")) - before
    held = {r.slot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    assert rows and all(held[r.virtual_slot] == r.shard for r in rows)


def test_a_third_of_the_rows_under_one_id_or_alike(spark):
    same_id = spark.range(60_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "concat('text ', id) AS text")
    alike = spark.range(60_000).selectExpr("5L AS doc_id", "'the same text in all of these rows' AS text")
    rest = spark.range(60_000).selectExpr("id + 100 AS doc_id", "concat('other ', id) AS text")
    rows = cut(records(same_id.unionByName(alike).unionByName(rest)))
    sizes = slot_sizes(rows)
    assert max(n for _, n in sizes.values()) < 600
    got = placed(rows, map_rows(spark, first_map(sizes, 8), sizes, 1)).groupBy("shard").agg(F.sum("size").alias("held"), F.count("*").alias("n"), F.countDistinct("slot").alias("places"), F.max("slot").alias("last")).collect()
    assert sum(r.n for r in got) == 180_000 and all(r.n == r.places == r["last"] + 1 for r in got)
    assert max(r.held for r in got) - min(r.held for r in got) < 600 * 35


def test_the_query_against_brute_force(spark):
    from riffle.llm.sharding import op10_virtual_slot_sharding

    docs_of = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op10_virtual_slot_sharding(spark, "/root/testdata/sf0.01").collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs_of.items()} and len(got) == len(docs_of)
    held, places = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        held[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert sorted(held) == list(range(8)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(held.values()) - min(held.values()) <= max(r.size for r in got)
