"""BPE encoding and decoding with batched merge rounds, and token counts with a whole-token shortcut.

The vocabulary file is a word-level BPE with an end-of-word mark. Texts are normalised and cut into pre-tokens; the
distinct pre-tokens of a batch that are not known yet are merged together: their symbols lie in one flat array, every
round looks up all adjacent pairs by binary search over the sorted pair keys, takes the lowest rank in each word, and
merges all its places there from left to right. Merging all places at once equals merging one at a time because no pair
made by a merge ranks below it; loading proves that for the file, and a file without it gets one place a round.

Counting needs no ids: vocabulary strings proved to encode alone as one token are counted straight away, and only other
pre-tokens are merged.

Defined results: a null text is an empty text without tokens; special strings inside a text are their one token; long
texts are worked through in segments cut at white space, where no token crosses; repeated rows repeat; rows with a null
id come back with a null id; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riffle.session import table

#: Fixed value: the end-of-word mark of the vocabulary file.
END = "</w>"
#: Characters whose case, class and composition are the same for every Unicode version; other texts take the tokenizer's own normaliser.
UNUSUAL = re.compile("[^\t\n\r -~¡-¬®-ɏ–—‘’“”…]")
#: Characters of text held as pre-tokens at a time, and pre-tokens remembered by a worker.
SEGMENT, KNOWN = 1 << 20, 200_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        file = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = [""] * (max(*vocab.values(), *self.special.values()) + 1)
        for t, i in (vocab | self.special).items():
            self.tokens[i] = t
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pattern = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inside = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + END] for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])]
        merges = np.array(pairs, np.int64)
        key = merges[:, 0] << 32 | merges[:, 1]
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, merges[order, 2]
        used = np.full(len(self.tokens), len(pairs))
        for side in (1, 0):
            np.minimum.at(used, merges[:, side], np.arange(len(pairs)))
        #: No merge makes a pair that ranks below the merge itself.
        self.all_places = bool((used[merges[:, 2]] > np.arange(len(pairs))).all())

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after another, and the number of ids of each. No word is empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inside[raw], np.repeat(np.arange(len(words)), size)
        end = np.cumsum(size) - 1
        sym[end] = self.last[raw[end]]
        none = len(self.keys)
        done_word, done_sym = [], []
        while len(sym):
            pair = sym[:-1] << 32 | sym[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == none] = 0
            rank = np.full(len(sym), none)
            hit = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            each = np.diff(np.append(first, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, first), each)
            over = least == none
            done_word.append(word[over])
            done_sym.append(sym[over])
            here = (rank == least) & ~over
            place = np.flatnonzero(here)
            if self.all_places:  # of places that overlap, every second one from the left
                run = np.concatenate(([True], np.diff(place) > 1)) if len(place) else np.zeros(0, bool)
                start = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0)) if len(place) else place
                place = place[(place - place[start]) % 2 == 0] if len(place) else place
            else:
                place = place[np.concatenate(([True], word[place][1:] != word[place][:-1]))] if len(place) else place
            sym[place] = self.made[at[place]]
            stay = ~over
            stay[place + 1] = False
            sym, word = sym[stay], word[stay]
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text; special strings stand as they are."""
        if "<|" in text and len(parts := self.split_special.split(text)) > 1:
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.plain_words(part))]
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[str]:
        if UNUSUAL.search(text) is None:
            return self.pattern.findall(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, p)).decode("utf-8", "surrogateescape") for p, _ in pieces]

    def ids_of(self, words: Iterable[str], known: dict[str, bytes]) -> None:
        """Adds to ``known`` the packed ids of the words that it lacks."""
        if new := [w for w in set(words) if w not in known]:
            for w in [w for w in new if w in self.special]:
                known[w] = np.array([self.special[w]], "<u4").tobytes()
            if new := [w for w in new if w not in self.special]:
                ids, n = self.merge([w.encode("utf-8", "surrogateescape") for w in new])
                packed, end = ids.astype("<u4").tobytes(), (np.cumsum(n) * 4).tolist()
                known.update(zip(new, (packed[a:b] for a, b in zip([0, *end], end, strict=False)), strict=True))

    def whole_tokens(self) -> set[str]:
        """Vocabulary strings proved to encode alone as their one token."""
        at = [(t, i) for i, t in enumerate(self.tokens) if t.endswith(END) and len(t) > len(END) and t not in self.special]
        raw = [bytes(map(self.byte_of.__getitem__, t[: -len(END)])) for t, _ in at]
        ids, n = self.merge(raw)
        first = np.cumsum(n) - n
        alone = (n == 1) & (ids[first] == [i for _, i in at])
        return {w.decode("utf-8") for w, ok in zip(raw, alone, strict=True) if ok and _is_text(w)}


def _is_text(w: bytes) -> bool:
    try:
        return bool(w.decode("utf-8"))
    except UnicodeDecodeError:
        return False


@lru_cache(2)
def load(path: str) -> WordBpe:
    """Once for each worker process."""
    return WordBpe(path)


@lru_cache(2)
def whole(path: str) -> frozenset[str]:
    return frozenset(load(path).whole_tokens())


def segments(text: str) -> Iterator[str]:
    """Parts of a long text, cut at white space."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = next((m.start() for m in [re.compile(r"[ \n]").search(text, at + SEGMENT)] if m), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def batches_of(column: pa.Array, first: int = 0) -> Iterator[list[tuple[int, str]]]:
    """Rows of a text column as (row, text segment), about ``SEGMENT`` characters at a time."""
    held, n = [], 0
    for row, text in enumerate(column):
        for part in segments(text.as_py() or ""):
            held.append((row + first, part))
            n += len(part)
            if n >= SEGMENT:
                yield held
                held, n = [], 0
    yield held


def encode_documents(docs: DataFrame, path: str, packed: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids``; ids packed as little-endian unsigned 32-bit integers, or an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = load(path), {}
        for batch in batches:
            held: list[bytes] = []  # of the rows not given on yet; the last may go on in the next segment
            done = 0
            for part in batches_of(batch.column(1)):
                cut = [(row, model.words(text)) for row, text in part]
                if len(known) > KNOWN:
                    known.clear()
                model.ids_of((w for _, ws in cut for w in ws), known)
                for row, ws in cut:
                    ids = b"".join(map(known.__getitem__, ws))
                    if row < done + len(held):
                        held[-1] += ids
                    else:
                        held.append(ids)
                if len(held) > 1:
                    yield out(batch.column(0).slice(done, len(held) - 1), held[:-1])
                    done, held = done + len(held) - 1, held[-1:]
            yield out(batch.column(0).slice(done, len(held)), held)

    def out(ids: pa.Array, rows: list[bytes]) -> pa.RecordBatch:
        count = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        if packed:
            values = pa.array(rows, pa.binary())
        else:
            flat = np.frombuffer(b"".join(rows), "<i4")
            values = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([ids, pa.array(count), values], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, ids {'binary' if packed else 'array<int>'}")


def decode_documents(encoded: DataFrame, path: str, packed: bool = True) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids, packed or an array) with the ``text`` that the ids stand for: tokens with a space between, as the file names no decoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = load(path).tokens.__getitem__
        for batch in batches:
            at, n = 0, 0
            texts: list[str] = []
            for ids in batch.column(2):
                texts.append(" ".join(map(token, np.frombuffer(ids.as_py(), "<u4").tolist() if packed else ids.as_py())))
                n += len(texts[-1])
                if n > 4 * SEGMENT:
                    yield out(batch.slice(at, len(texts)), texts)
                    at, n, texts = at + len(texts), 0, []
            yield out(batch.slice(at, len(texts)), texts)

    def out(rows: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id long, n_tokens long, ids {'binary' if packed else 'array<int>'}, text string")


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens``: whole-token pre-tokens count one, only the rest is merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        alone = dict.fromkeys([*whole(path), *model.special], 1)
        rest: dict[str, int] = {}
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            for part in batches_of(batch.column(1)):
                cut = [(row, model.words(text)) for row, text in part]
                if len(rest) > KNOWN:
                    rest.clear()
                if new := list({w for _, ws in cut for w in ws} - alone.keys() - rest.keys()):
                    rest.update(zip(new, model.merge([w.encode("utf-8", "surrogateescape") for w in new])[1].tolist(), strict=True))
                for row, ws in cut:
                    total[row] += sum(alone.get(w) or rest[w] for w in ws)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def _file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), _file()).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode_documents(encode_documents(table(spark, sf_dir, "documents"), _file()), _file())
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op6_token_counts": op6_token_counts, "op7_bpe_round_trip": op7_bpe_round_trip}
ORACLES: dict[str, str] = {}
