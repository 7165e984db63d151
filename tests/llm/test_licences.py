from pyspark.sql import functions as F

from riffle.llm.licences import ORACLES, TEMPLATES, THRESHOLD, WORDS, Matcher, licence_matches, op2_licence_scan, pairs
from riffle.llm.simhash import LOWER
from tests.oracle import same


def slow(text, templates=TEMPLATES, threshold=THRESHOLD):
    """The best of all windows, each compared by itself."""
    words = WORDS.findall((text or "").encode().translate(LOWER))
    out = []
    for k, (name, t) in enumerate(templates):
        b, best = pairs(WORDS.findall(t.encode().translate(LOWER))), None
        most = int(len(b) * (2 - threshold) / threshold + 1e-9)
        for i in range(len(words) - 1):
            for j in range(i + 1, min(len(words), i + 1 + most)):
                a = pairs(words[i : j + 1])
                if (dice := 2 * len(a & b) / (len(a) + len(b))) >= threshold and (best is None or dice > best[2]):
                    best = (k, name, dice, i, j)
        out += [best] if best else []
    return out


SHORT = [t for t in TEMPLATES if len(t[1]) < 120]
HEADER = "# ".join(line + "\n" for line in ("This program is free software: you can redistribute it and/or", "modify it under the terms of the GNU General Public License as", "published by the Free Software Foundation, either version 3 of the", "License, or (at your option) any later version."))


def test_against_brute_force(spark):
    some = [None, "", "one", "\n\n", *[t for _, t in SHORT], SHORT[2][1].upper().replace(" ", "\n"), "Released under an MIT license.\nx y", "(c) 2001\n" + SHORT[2][1], "a b " * 100, (SHORT[1][1] + "\n") * 3, "some words before, licensed under the Apache licence version 2.0 and after"]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(some)] + [(None, some[6], 1.0), (6, some[6], 1.0)], "doc_id long, text string, dice double")
    rows = licence_matches(docs, SHORT).collect()
    assert len(rows) == len(some) + 2
    for r in rows:
        assert [tuple(m) for m in r.matches] == slow(some[6 if r.doc_id is None else r.doc_id], SHORT)
    assert licence_matches(docs.where(F.lit(False))).count() == 0


def test_wrapped_notices_and_full_texts_inside_long_files(spark):
    code = "\n".join(f"let x{i} = y{i} + {i};" for i in range(400))
    texts = [f"{code}\n# {HEADER}\n{code}", *[f"{code} {text} {code}" for _, text in TEMPLATES], "w " * 500_000 + HEADER]
    rows = {r.doc_id: r.matches for r in licence_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert any(m.licence == "GPL-3.0-or-later" and m.dice == 1 for m in rows[0]) and any(m.licence == "GPL-3.0-or-later" for m in rows[len(texts) - 1])
    for k in range(len(TEMPLATES)):
        assert any(m.template == k and m.dice == 1 for m in rows[k + 1])


def test_pieces_lose_no_window(monkeypatch):
    from riffle.llm import licences

    data = ("x y z " * 50 + HEADER + "p q " * 40 + TEMPLATES[8][1]).encode().translate(LOWER)
    want = Matcher(TEMPLATES, THRESHOLD).matches(data)
    assert {TEMPLATES[k][0] for k, *_ in want} >= {"GPL-3.0-or-later", "MPL-2.0"}
    for piece in (64, 100, 333):
        monkeypatch.setattr(licences, "PIECE", piece)
        assert Matcher(TEMPLATES, THRESHOLD).matches(data) == want


def test_bounds_never_hide_a_match():
    for threshold in (0.5, 0.8, 1.0):
        for _, t in SHORT:
            data = t.encode().translate(LOWER)
            for cut in range(2, len(data), 7):
                got = Matcher(SHORT, threshold).matches(data[:cut])
                assert [(k, SHORT[k][0], d, a, b) for k, d, a, b in got] == slow(data[:cut].decode(), SHORT, threshold)


def test_against_sql(spark):
    n, extra, missing = same(spark, op2_licence_scan, ORACLES["op2_licence_scan"], "/root/testdata/sf0.01")
    assert n and not extra and not missing, (extra, missing)
