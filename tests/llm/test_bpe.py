import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.llm import bpe
from riffle.llm.bpe import _file, count_tokens, decode_documents, encode_documents, load, op6_token_counts, op7_bpe_round_trip, whole
from riffle.session import table
from tests.oracle import duck

TEXTS = [
    None, "", " \n", "Hello world's 123 don't WE'LL", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|> <|endoftext|", "é é ΑΣ ς İ ŉ ﬁ ǅ", "日本語 한국어 עברית  x y​z", "🙂🙂👩‍👩‍👧 ퟿",
    "aaaaaaaaaaaaaaaaaaaaaaaaa " * 3, "x" * 5000, "ababababab" * 400, "a\x1cb\x85c　d\x00e\x7f", "!!!!!!????...,,,;;", "Ⅷ ² ½ ٣ १२", "tab\tnew\r\nline\x0bv\x0cf", "word " * 40_000 + "\n" + "Ünï " * 10_000,
]


def expected(text):
    model = load(_file()).library
    ids = model.encode(text or "", add_special_tokens=False).ids
    return ids, model.decode(ids, skip_special_tokens=False)


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, b"x", 5) for i, t in enumerate(texts)] + [(None, "null id", b"y", 6), (3, TEXTS[3], b"z", 7)], "doc_id long, text string, ids binary, n_tokens int")


def test_encoding_and_decoding_equal_the_library(spark):
    rows = decode_documents(encode_documents(frame(spark), _file()), _file()).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        ids, text = expected(TEXTS[r.doc_id] if r.doc_id is not None else "null id")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.text == text
    arrays = {r.doc_id: r.ids for r in encode_documents(frame(spark), _file(), packed=False).collect()}
    assert all(arrays[i] == expected(t)[0] for i, t in enumerate(TEXTS))


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 64)
    text = "Hello big   world, it's <|endoftext|> here\n" * 30 + "y" * 200 + " end"
    assert sum(map(len, bpe.segments(text))) == len(text) and max(map(len, bpe.segments(text))) < 300
    model = load(_file())
    assert [w for s in bpe.segments(text) for w in model.words(s)] == model.words(text)


def test_counts_equal_the_library(spark):
    rows = count_tokens(frame(spark), _file()).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        t = TEXTS[r.doc_id] if r.doc_id is not None else "null id"
        assert (r.n_bytes, r.n_tokens) == (len((t or "").encode()), len(expected(t)[0]))


def test_the_shortcut_is_proved():
    model = load(_file())
    assert model.all_places
    sure = whole(_file())
    assert len(sure) > 30_000
    for w in sorted(sure)[::500]:
        assert len(model.merge([w.encode()])[0]) == 1


def test_one_place_a_round_gives_the_same(monkeypatch):
    model = load(_file())
    words = [b"aaaaaaa", b"banana", b"mississippi", b"hahahahahaha", "ñandú".encode()]
    want = model.merge(words)
    monkeypatch.setattr(model, "all_places", False)
    got = model.merge(words)
    assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_on_the_table(spark, sf):
    texts = dict(duck(sf).execute("SELECT doc_id, text FROM documents").fetchall())
    counts = {r.doc_id: r for r in op6_token_counts(spark, sf).collect()}
    trips = {r.doc_id: r for r in op7_bpe_round_trip(spark, sf).collect()}
    assert counts.keys() == trips.keys() == texts.keys()
    for i, t in texts.items():
        ids, back = expected(t)
        assert counts[i].n_tokens == len(ids) and counts[i].over_limit == (len(ids) > 2048)
        assert trips[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and trips[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_empty_table(spark):
    none = table(spark, "/root/testdata/sf0.001", "documents").where(F.lit(False))
    assert decode_documents(encode_documents(none, _file()), _file()).count() == 0 and count_tokens(none, _file()).count() == 0
