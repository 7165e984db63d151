from collections import defaultdict

from pyspark.sql import functions as F

from riffle.llm.lines import SPACE, dedup_lines, op4_line_dedup, ORACLES
from riffle.llm.simhash import LOWER
from tests.oracle import same

LONG = "This line is long enough to count as one, " + "x" * 10


def slow(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACE).encode().translate(LOWER).decode()
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = [(i, f"only here {i}\n  {LONG.upper() if i % 2 else LONG}\t\nend") for i in range(6)]
    rows += [(10, None), (11, ""), (12, LONG + "\n" + LONG), (13, "é" * 40), (14, "É" * 40), (15, "é" * 40), (16, "é" * 40), (17, "　" + "é" * 40), (None, LONG), (2, rows[2][1]), (2, LONG), (18, "\n\n")]
    rows += [(20 + i, "y" * 39) for i in range(6)] + [(30 + i, "z" * 40) for i in range(6)] + [(40, "\n".join([LONG] * 20_000 + ["tail"]))]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_lines int, `__odd.name` string")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "__odd.name", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == slow(rows)
    assert dedup_lines(docs.where(F.lit(False))).count() == 0


def test_against_sql(spark):
    n, extra, missing = same(spark, op4_line_dedup, ORACLES["op4_line_dedup"], "/root/testdata/sf0.001")
    assert n and not extra and not missing, (extra, missing)


def test_columns_of_any_name(spark):
    rows = [(i, f"{LONG}\nown {i}") for i in range(6)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f", "g") for r in rows], "doc_id long, text string, __key string, id string, tag string, drop string, lines string, N_LINES string, `row.doc_id` string")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "__key", "id", "tag", "drop", "lines", "row.doc_id", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, t if i == 5 else f"own {i}", "a", "b", "c", "d", "e", "g", 2, int(i < 5)) for i, t in rows)
