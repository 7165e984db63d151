import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riffle.llm import simhash
from riffle.llm.simhash import bucket_links, components, covering_masks, near_duplicates, near_links


def slow_fingerprint(text, k=4):
    words = (text or "").encode().translate(simhash.LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius):
    label = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(0)
    masks = covering_masks(4)
    assert len(masks) == 31 and min(m.bit_count() for m in masks) >= 30
    for _ in range(2000):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & diff == 0 for m in masks)


def dense(rng, centres, each, flips=3):
    out = set()
    for c in rng.integers(0, 2**63, centres).tolist():
        for _ in range(each):
            out.add(c ^ sum(1 << int(b) for b in set(rng.integers(0, 63, flips).tolist())))
    return sorted(out)


HALVES = simhash.Shape(words=2, width=32, each=4, reach=9)


def halves(x):
    return (x >> 32, x & (2**32 - 1))


@pytest.mark.parametrize(("shape", "max_bucket"), [(simhash.PLAIN, 20_000), (simhash.PLAIN, 16), (HALVES, 20_000), (HALVES, 60)])
def test_links_connect_what_brute_force_connects(spark, shape, max_bucket):
    fps = dense(np.random.default_rng(5), 12, 40) + [0, 1, 3]
    rows = [halves(x) if shape.words > 1 else (x,) for x in fps]
    links = near_links(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in shape.columns)), shape, max_bucket).collect()
    whole = [((r.f0 << 32 | r.f1, r.g0 << 32 | r.g1) if shape.words > 1 else (r.f0, r.g0), r.d) for r in links]
    assert all((a ^ b).bit_count() == d <= shape.reach for (a, b), d in whole)
    assert shape.covered == shape.reach
    want = slow_components(fps, shape.reach)
    got = {r.node: r.root for r in components(spark.createDataFrame([p for p, _ in whole], "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in fps} == want


def test_wide_masks_cover_fourteen_bits_and_most_pairs_in_reach():
    rng = np.random.default_rng(1)
    found = {}
    for n in (14, 16, 19):
        met = 0
        for _ in range(1000):
            bits = rng.choice(96, n, replace=False)
            differ = [sum(1 << int(b % 32) for b in bits if b // 32 == w) for w in range(3)]
            hit = [t for t, (w, m) in enumerate(simhash.WIDE.masks) if not m & differ[w]]
            assert simhash.WIDE.first_table([np.array([d], np.uint64) for d in differ])[0] == (hit[0] if hit else -1)
            met += bool(hit)
        found[n] = met / 1000
    assert simhash.WIDE.covered == 14 and found[14] == 1 and found[16] > 0.9 and found[19] > 0.6


def test_a_bucket_split_over_batches_loses_nothing():
    import pyarrow as pa

    shape = simhash.Shape()
    shape.__dict__["masks"] = [(0, 0)]  # one table with one bucket
    fps = np.array(dense(np.random.default_rng(2), 1, 300), dtype=np.int64)
    n = len(fps)
    whole = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(fps)], names=["t", "k", "f0"])
    links = [b for b in bucket_links(shape, 1000)(whole.slice(i, 7) for i in range(0, n, 7))]
    pairs = {(x, y) for b in links for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)}
    label = {int(x): int(x) for x in fps}
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert label == slow_components([int(x) for x in fps], 4)
    pairs_seen = {(min(p), max(p)) for p in pairs}
    assert len(pairs_seen) == len(pairs)
    over = [b for b in bucket_links(shape, 50)(whole.slice(i, 7) for i in range(0, n, 7))]
    assert sum(b.num_rows for b in over if b.column(0)[0].as_py() == 0) == n


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(3, None, "x"), (1, "", "y"), (2, "\t \n", None), (5, long, "a"), (4, long, "a"), (4, long, "a"), (7, "One two", "b"), (8, "ONE\x0btwo", "b"), (9, "é É", "b"), (None, "z", "c"), (None, "z", "c"), (None, "one two", "c")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, f0 int, component_id int, `a.b` int")
    got = sorted(((r.doc_id or 99), r.f0 & (2**64 - 1), r.component_id) for r in near_duplicates(docs).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 4, 5, 7, 8, 9, 99, 99, 99]
    assert {g[0]: g[2] for g in got if g[0] < 99} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 9}
    assert [g[2] for g in got if g[0] == 99].count(7) == 1 and [g[2] for g in got if g[0] == 99].count(None) == 2
    assert all(g[1] == slow_fingerprint(dict((i, t) for i, t, _ in rows)[g[0]]) for g in got if g[0] not in (4, 5, 99))
    assert simhash.fingerprint(long, 4) == [slow_fingerprint(long)]
    assert near_duplicates(docs.where(F.lit(False))).count() == 0


def test_the_query_against_brute_force(spark):
    from pyspark.sql import types as T

    got = simhash.op1_simhash_near_dedup(spark, "/root/testdata/sf0.01")
    assert isinstance(got.schema["doc_id"].dataType, T.LongType)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    fp = {i: slow_fingerprint(t) for i, t in texts.items()}
    label = slow_components(sorted(set(fp.values())), 4)
    least = {}
    for i, f in fp.items():
        least[label[f]] = min(i, least.get(label[f], i))
    rows = got.collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{f:016x}", least[label[f]]) for i, f in fp.items()}


def test_links_of_dissimilar_texts_do_not_count(spark):
    texts = ["a b c d e f", "a b c d e f", "x y z u v w", "p q r s t o n m"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_duplicates(docs, 5, simhash.Shape(2, 48, 0, 96), 0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert sorted(r.doc_id for r in got if r.stays) == [0, 2, 3]


def family(rng, copies, least, most, n=150):
    base = [f"w{i}" for i in rng.integers(0, 3000, n)]
    texts = [" ".join(base)]
    for _ in range(copies):
        words = list(base)
        for at in rng.choice(n, int(rng.integers(least, most + 1)), replace=False):
            words[at] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(words))
    return texts


def grams_of(text, k=5):
    words = text.split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def slow_groups(texts, shape, similarity):
    """Groups by every pair that meets in some table within reach and whose texts are similar enough."""
    fps, sets, label = [simhash.fingerprint(t, 5, shape) for t in texts], [grams_of(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            differ = [a ^ b for a, b in zip(fps[i], fps[j], strict=True)]
            meet = sum(d.bit_count() for d in differ) <= shape.reach and any(not differ[w] & m for w, m in shape.masks)
            if meet and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return dict(enumerate(label))


@pytest.mark.parametrize(("shape", "max_bucket"), [(simhash.WIDE, 20_000), (simhash.WIDE, 40), (simhash.Shape(2, 48, 4, 9, 4), 20_000), (simhash.Shape(2, 48, 4, 9, 4), 40)])
def test_no_similar_pair_hides_behind_a_dissimilar_one(spark, shape, max_bucket):
    texts = family(np.random.default_rng(7), 150, 2, 9)
    want = slow_groups(texts, shape, 0.8)
    assert 1 < len(set(want.values())) < 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_duplicates(docs, 5, shape, 0.8, max_bucket).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_pairs_at_the_stated_similarity_are_found(spark):
    """Pairs between 0.8 and 0.9, each by itself: nine in ten are found, and nothing below 0.8 is."""
    rng = np.random.default_rng(3)
    rows, similar = [], {}
    for i in range(400):
        n = int(rng.integers(60, 400))
        base = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        other = list(base)
        for at in rng.choice(n, max(1, int(n * rng.uniform(0.01, 0.035))), replace=False):
            other[at] = f"x{rng.integers(0, 10**9)}"
        a, b = grams_of(" ".join(base)), grams_of(" ".join(other))
        similar[i] = len(a & b) / len(a | b)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, simhash.WIDE, 0.8).collect()}
    found = {i: got[2 * i + 1] == 2 * i for i in similar}
    wanted = [i for i, j in similar.items() if 0.8 <= j < 0.9]
    lowest = [i for i, j in similar.items() if 0.8 <= j < 0.83]
    assert len(lowest) > 40 and sum(found[i] for i in lowest) >= 0.85 * len(lowest)
    assert sum(found[i] for i in wanted) >= 0.9 * len(wanted)
    assert not any(found[i] for i, j in similar.items() if j < 0.8)


def test_texts_of_one_fingerprint_are_compared(spark):
    rng = np.random.default_rng(1)
    tail = [[f"t{x}" for x in rng.integers(0, 10**6, 20)] for _ in range(60)]
    texts = [" ".join(["spam"] * 100 + w) for w in tail] + [" ".join(["spam"] * 104 + tail[3]), " ".join(["spam"] * 100 + [*tail[5], "more"])]
    assert len({tuple(simhash.fingerprint(t, 5, simhash.WIDE)) for t in texts}) < 10
    docs = spark.createDataFrame([*enumerate(texts), (70, texts[8]), (8, texts[9]), (80, None), (81, "")], "doc_id long, text string")
    got = {(r.doc_id, r.tag): r.component_id for r in near_duplicates(docs, 5, simhash.WIDE, 0.8, 20).collect()}
    root = {i: [v for (x, _), v in sorted(got.items()) if x == i] for i in range(82)}
    assert all(root[i] == [i] for i in range(60) if i not in (8, 9))
    assert root[60] == [3] and root[61] == [5] and root[70] == [8] and root[80] == root[81] == [80]
    assert root[8] == [8, 8] and root[9] == [8]
    kept = sorted((r.doc_id, r.text) for r in simhash.one_of_each(docs.where("doc_id < 80")).collect())
    assert len({t for _, t in kept}) == len(kept) == 60


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "p q r s t u", 2), (None, "p q r s t u", 3), (None, "other words here", 4), (5, "p q r s t u", 5), (6, None, 6)]
    docs = spark.createDataFrame([(*r, "k", "i", "t", "n", "w", "d", "DOC") for r in rows], "doc_id long, text string, n int, __key string, id string, tag string, none string, `row` string, `a.b` string, Doc_Id2 string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "other words here"), (1, "a b c d e f"), (5, "p q r s t u"), (6, "")]
    assert all(tuple(r)[3:] == ("k", "i", "t", "n", "w", "d", "DOC") for r in got)


def test_chance_links_do_not_make_all_pairs_of_a_group(spark, monkeypatch):
    """Unrelated texts under narrow fingerprints: chance links chain them into one group, of which only pairs that meet are compared."""
    shape = simhash.Shape(words=3, width=16, each=2, reach=12, near=4)
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 12))) for _ in range(6_000)]
    texts += [texts[0] + " x", texts[0] + " y"]  # two that are alike
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    compared, whole = [], []
    alike, between = simhash.alike, simhash.links_between_parts
    monkeypatch.setattr(simhash, "alike", lambda pairs, *a: compared.append(pairs.count()) or alike(pairs, *a))
    monkeypatch.setattr(simhash, "links_between_parts", lambda members, *a: whole.append(members.groupBy("group").count().selectExpr("sum(count * count)").first()[0] or 0) or between(members, *a))
    got = {r.doc_id: r.component_id for r in near_duplicates(rows, 5, shape, 0.6).collect()}
    assert {i for i, c in got.items() if i != c} == {6_000, 6_001} and got[6_000] == got[6_001] == 0
    fp = np.array([simhash.fingerprint(t, 5, shape) for t in texts], np.uint64)
    meet = 0
    for a in range(len(fp) - 1):
        d = [fp[a, w] ^ fp[a + 1 :, w] for w in range(3)]
        near = sum(np.bitwise_count(x) for x in d) <= shape.reach
        meet += int((shape.first_table([x[near] for x in d]) >= 0).sum())
    largest = 1_000  # one group holds at least so many
    assert meet > 6_000 and compared[0] > largest, "chance links chain the texts together"
    assert sum(compared) <= 2 * meet and sum(whole) <= simhash.DENSE * meet


@pytest.mark.parametrize(("max_bucket", "blocks"), [(20_000, 1), (40, 4)])
def test_groups_of_few_texts_are_not_dealt_to_buckets(spark, monkeypatch, max_bucket, blocks):
    """A group of few texts is compared by all its fingerprints: no row for each table, and the pairs are those that the buckets give."""
    texts = family(np.random.default_rng(7), 139, 2, 9) + family(np.random.default_rng(8), 9, 2, 9)
    fps = [simhash.fingerprint(t, 5, simhash.WIDE) for t in texts]
    rows = [(i // 140, i, 146, *f) for i, f in enumerate(fps)] + [(2, 200 + i, 146, *f) for i, f in enumerate(fps[:30])]  # the last group is one part
    members = spark.createDataFrame(rows, "group long, node long, n int, f0 long, f1 long, f2 long").cache()
    parts = members.selectExpr("node", "CASE WHEN group = 2 THEN 200 WHEN node % 140 < 10 THEN node - node % 5 ELSE node END AS root").cache()
    root = {r.node: r.root for r in parts.collect()}
    want, counted = {}, {}
    for a in range(len(fps)):
        for b in range(a + 1, len(fps)):
            differ = [x ^ y for x, y in zip(fps[a], fps[b], strict=True)]
            d = sum(x.bit_count() for x in differ)
            hit = [w for w, m in simhash.WIDE.masks if not differ[w] & m]
            if a // 140 == b // 140 and root[a] != root[b] and d <= 22 and hit:
                want[a, b] = d
                counted[a // 140] = counted.get(a // 140, 0) + (hit[0] == 0)
    assert len(want) > 1_000 and 0 < sum(counted.values()) < len(want)

    def found(words):
        return simhash.meetings(members, parts, simhash.WIDE, max_bucket, words)

    def check():
        named = found(None).mapInArrow(simhash.meeting_pairs(simhash.WIDE, 0.8, True), "a long, b long, d int").collect()
        assert len(named) == len(want) and {(min(r.a, r.b), max(r.a, r.b)): r.d for r in named} == want
        some = found(1).mapInArrow(simhash.meeting_pairs(simhash.WIDE, 0.8, False, 1), "group long, m long").groupBy("group").sum("m").collect()
        assert {r[0]: r[1] for r in some} == {g: m for g, m in counted.items() if m}

    assert found(None).count() == found(1).count() == 140 * blocks + 10
    check()
    monkeypatch.setattr(simhash, "FEW_TEXTS", 100)  # the larger group goes to its buckets
    check()
    assert found(None).count() > 10 * 140
