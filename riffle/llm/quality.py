"""Quality classifier: a generalised additive model with pairwise interactions.

Each whole text gives a few measures. The model adds one number for each measure and some numbers for pairs of measures,
all read from lookup tables over bins, and turns the sum into a probability. The tables are learned by cyclic boosting:
one measure after the other, round after round, a shallow tree over the measure's bins takes a small step against the log
loss; then the pairs with the strongest interaction are boosted likewise with one cut on either side.

Learning takes at most ``MOST_LABELS`` labelled documents, chosen by a hash of their id, so that the choice is the same
at every run; the histograms of so many rows fit any driver. Scoring runs inside tasks: binary search for the bins, then
additions. Labels, language, source and id are never inputs of a score.

Defined results: a null text is an empty text and gets a score like any other; labels other than 0 and 1 are left out, a
document labelled twice has the larger label, a labelled id with several texts is learned from one of them; without labels, or with labels of one kind, every score is the smoothed
share of good labels; repeated rows score alike; an empty table gives an empty result. Other columns come through ``scored``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.session import table

#: Bound of the sample of labelled rows that the model is learned from.
MOST_LABELS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 12, 8
ROUNDS, PAIR_ROUNDS, STEP, DEPTH = 120, 60, 0.15, 2
#: Bytes of text measured at a time.
CHUNK = 1 << 16
MEASURES = ("log_words", "word_length", "upper", "symbol", "shout", "bar", "digit", "other_script", "stop", "break", "repeat", "distinct", "packed", "first_upper")

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#$%&*@^~<>{}[]=+_\\/`", b"!?", b"|", b"0123456789", bytes(range(128, 256)), b".,;:", b"\n"), 1):
    _CLASS[list(_chars)] = _k


def measure(text: str | None) -> list[float]:
    """The measures of one text, in the order of MEASURES. Shares of words are taken chunk by chunk, so length alone does not move them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    kinds = np.zeros(10, np.int64)
    words = letters = repeats = distinct = capital = packed = 0
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        kinds += np.bincount(_CLASS[np.frombuffer(part, np.uint8)], minlength=10)
        ws = part.split()
        words += len(ws)
        letters += sum(map(len, ws))
        repeats += sum(a == b for a, b in zip(ws, ws[1:], strict=False))
        distinct += len(set(ws))
        capital += sum(w[0] - 65 < 26 and w[0] >= 65 for w in ws)
        packed += len(zlib.compress(part, 1))
    w = max(1, words)
    upper, lower, symbol, shout, bar, digit, other, stop, line = kinds[1:].tolist()
    return [np.log1p(words), letters / w, upper / max(1, upper + lower), symbol / n, shout / w, bar / w, digit / n, other / n, stop / w, line / w, repeats / w, distinct / w, packed / n, capital / w]


def measures(texts) -> np.ndarray:
    return np.array([measure(t) for t in texts], np.float64).reshape(-1, len(MEASURES))


@dataclass
class Additive:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cut, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += t[np.searchsorted(cut, x[:, j], side="right")]
        for a, b, t in self.pairs:
            total += t[np.searchsorted(self.pair_cuts[a], x[:, a], side="right"), np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A tree over ordered bins: the Newton step of each bin, from sums of gradients and curvatures."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if depth and len(cg):
        gain = cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1)
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + 1))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts over two ordered axes: its gain, and the Newton steps of the four quarters."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarter = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    qg, qh = quarter(cg), quarter(ch)
    gain = sum(a**2 / (b + 1) for a, b in zip(qg, qh, strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    step = np.zeros_like(g)
    for (r, c), a, b in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), qg, qh, strict=True):
        step[r, c] = a[i, j] / (b[i, j] + 1)
    return float(gain[i, j]), step


def learn(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of measures ``x`` (one row for each labelled text) and labels ``y`` (0 or 1)."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not 0 < y.sum() < len(y):
        return Additive(base)
    d = x.shape[1]
    cuts = [_cuts(x[:, j], BINS) for j in range(d)]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            step = STEP * _tree(np.bincount(at[j], g, len(tables[j])), np.bincount(at[j], h, len(tables[j])), DEPTH)
            tables[j] += step
            total += step[at[j]]
    pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    pair_at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(pair_cuts)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1
        return np.bincount(pair_at[a] * shape[1] + pair_at[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    best = sorted(((-_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(d) for b in range(a)))[:PAIRS]
    pairs = [(a, b, np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1))) for _, a, b in best]
    for _ in range(PAIR_ROUNDS):
        for a, b, t in pairs:
            g, h = slopes()
            step = STEP * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            t += step
            total += step[pair_at[a], pair_at[b]]
    return Additive(base, cuts, tables, pair_cuts, pairs)


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Additive:
    """Learns from at most ``most`` labelled documents outside the held-out fold."""
    known = labels.where((fold() != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "x": list(measures(part["text"])), "y": part["quality"]})

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id")
    got = rows.mapInPandas(run, "doc_id long, x array<double>, y int").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("m")).select("m.*").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(MEASURES))
    order = np.lexsort((*x.T, got["y"]))  # the same model whatever the order of rows
    return learn(x[order], got["y"].to_numpy(np.float64)[order])


def scored(docs: DataFrame, model: Additive, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in a column ``name``, in place of one of this name."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(measures(texts)))

    return docs.withColumn(name, score(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more."""
    rows = docs.select(F.struct("*").alias("row")).select("row", "row.text")  # no other name can clash with the columns of docs
    return scored(rows, fit(docs, labels)).where(F.col("score") >= least).select("row.*")


def op9_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op9_additive_quality": op9_additive_quality}
ORACLES: dict[str, str] = {}
