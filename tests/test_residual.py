"""Variable-length and arithmetic coding of H.264 against slow versions written bit by bit."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riffle.functions import cabac, cavlc
from riffle.functions.units import ERRORS, Cursor


def packed(bits):
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big") if bits else b""


def block(bits, nc):
    cursor = Cursor(pa.array([packed(bits)]))
    ones, total, levels = cavlc.read_block(cursor, np.array([nc]), cavlc.token_tables())
    return int(ones[0]), int(total[0]), levels[0, : total[0]].tolist(), int(cursor.at[0]), ERRORS[cursor.fault[0]]


def test_token_tables_are_prefix_codes():
    for codes, most in cavlc.CLASSES:
        assert len(codes) == len(set(codes)) == len(cavlc.token_pairs(most))
        assert not any(b.startswith(a) for a in codes for b in codes if a != b)
        assert 0.96 < sum(2.0 ** -len(c) for c in codes) <= 1


@pytest.mark.parametrize(("nc", "bits", "want"), [(5, "0001001", (0, 6)), (0, "1", (0, 0)), (1, "01", (1, 1)), (3, "0101", (3, 3)), (9, "000011", (0, 0)), (9, "111111", (3, 16)), (-1, "0000000", (3, 4)), (-2, "000000000111", (0, 7)), (2, "0000000000001", (3, 15))])
def test_tokens(nc, bits, want):
    tables = cavlc.token_tables()
    cursor = Cursor(pa.array([packed(bits + "1" * 16)]))
    kind = np.array([{-1: 4, -2: 5}.get(nc, 0 if nc < 2 else 1 if nc < 4 else 2 if nc < 8 else 3)])
    ones, total = cursor.lookup(tables, kind)
    assert (int(ones[0]), int(total[0])) == want
    assert cursor.at[0] == len(bits)


def test_faults():
    assert block("0000000000000000111", 0)[4] == "no such token"
    assert block("0000000" + "1" * 9, -1)[:2] == (3, 4)  # seven zeros are a token of their own, whatever comes behind
    assert block("0001001", -3)[4] == "invalid context number"
    assert block("", 0)[4] == block("000", 0)[4] == "ended early"
    assert block("000101" + "0" * 40 + "1", 0)[4] == "code too long"


def slow_levels(bits, ones, total):
    """One block, a bit at a time."""
    at, out, size = 0, [], 1 if total > 10 and ones < 3 else 0
    for _ in range(ones):
        out.append(1 - 2 * int(bits[at]))
        at += 1
    for i in range(ones, total):
        prefix = bits.index("1", at) - at
        at += prefix + 1
        n = 4 if prefix == 14 and size == 0 else prefix - 3 if prefix >= 15 else size
        suffix = int(bits[at : at + n] or "0", 2)
        at += n
        code = (min(15, prefix) << size) + suffix + (15 if prefix >= 15 and size == 0 else 0) + ((1 << prefix - 3) - 4096 if prefix >= 16 else 0) + (2 if i == ones and ones < 3 else 0)
        out.append((code + 2) // 2 if code % 2 == 0 else (-code - 1) // 2)
        size = max(size, 1)
        if abs(out[-1]) > 3 << size - 1 and size < 6:
            size += 1
    return out, at


def test_levels_of_random_bits():
    rng = np.random.default_rng(3)
    for _ in range(300):
        total = int(rng.integers(1, 17))
        ones = int(rng.integers(0, min(3, total) + 1))
        token = cavlc.CLASSES[3][0][cavlc.token_pairs(16).index((ones, total))]
        bits = "".join(map(str, (rng.random(1_500) < 0.35).astype(int)))
        want, at = slow_levels(bits, ones, total)
        assert block(token + bits, 8) == (ones, total, want, at + 6, None)


def test_written_blocks_come_back():
    rng = np.random.default_rng(11)
    nc = rng.choice([0, 1, 2, 3, 5, 8, 20, -1, -2], 400)
    most = np.where(nc == -1, 4, np.where(nc == -2, 8, 16))
    total = rng.integers(0, most + 1)
    ones = np.minimum(rng.integers(0, 4, 400), total)
    levels = rng.integers(2, 10 ** rng.integers(1, 7, (400, 1)), (400, 16)) * rng.choice([-1, 1], (400, 16))
    sign = rng.choice([-1, 1], (400, 16))
    levels = np.where(np.arange(16)[None] < ones[:, None], sign, levels)
    data, bad = cavlc.write_blocks(nc, ones, levels, total)
    assert not bad.any()
    cursor = Cursor(pa.array(data))
    got = cavlc.read_block(cursor, nc, cavlc.token_tables())
    assert not cursor.fault.any() and (got[0] == ones).all() and (got[1] == total).all()
    inside = np.arange(16)[None] < total[:, None]
    assert (got[2][inside] == levels[inside]).all()
    assert not cursor.bits("", 1, cursor.all).min() == 0  # the stop bit stands behind each


def test_blocks_without_a_code():
    bad = cavlc.write_blocks(np.array([0, -3, -1, 0, 0]), np.array([1, 0, 0, 0, 2]), np.array([[2, 3], [2, 2], [2, 2], [1, 2], [1, -1]]), np.array([2, 1, 5, 2, 2]))[1]
    assert bad.tolist() == [True, True, True, True, False]


def test_coefficients_stand_behind_their_runs(spark):
    rows = [([5, -1, 1], [2, 0, 1]), ([7], [0]), ([], []), ([3, 2], [0, 0])]
    df = spark.createDataFrame(rows, "levels array<int>, runs array<int>")
    got = [r[0] for r in df.select(cavlc.coefficients(F.col("levels"), F.col("runs"))).collect()]
    assert got == [[0, 1, -1, 0, 0, 5], [7], [], [2, 3]]


def test_context_number(spark):
    rows = [(True, 3, True, 4), (True, 3, False, 9), (False, 3, True, 9), (False, 1, False, 1)]
    df = spark.createDataFrame(rows, "a boolean, n int, b boolean, m int")
    assert [r[0] for r in df.select(cavlc.context_number(*map(F.col, "anbm"))).collect()] == [4, 3, 9, 0]


class SlowEncoder:
    """The coder as the standard writes it, with outstanding bits."""

    def __init__(self, pre):
        self.low, self.span, self.first, self.waiting, self.bits = 0, 510, True, 0, ""
        self.states = [[63 - p, 0] if p <= 63 else [p - 64, 1] for p in pre]

    def put(self, b):
        self.bits += "" if self.first else str(b)
        self.first = False
        self.bits += str(1 - b) * self.waiting
        self.waiting = 0

    def renorm(self):
        while self.span < 256:
            if self.low < 256:
                self.put(0)
            elif self.low >= 512:
                self.low -= 512
                self.put(1)
            else:
                self.low -= 256
                self.waiting += 1
            self.span *= 2
            self.low *= 2

    def write(self, b, c):
        if c == cabac.BYPASS:
            self.low = 2 * self.low + (self.span if b else 0)
            if self.low >= 1024:
                self.put(1)
                self.low -= 1024
            elif self.low < 512:
                self.put(0)
            else:
                self.low -= 512
                self.waiting += 1
            return
        if c == cabac.TERMINATE:
            self.span -= 2
            if b:
                self.low += self.span
                self.span = 2
                self.renorm()
                self.put(self.low >> 9 & 1)
                self.bits += f"{self.low >> 7 & 3 | 1:02b}"
            else:
                self.renorm()
            return
        state, mps = self.states[c]
        less = int(cabac.range_table()[state, self.span >> 6 & 3])
        self.span -= less
        if b != mps:
            self.low += self.span
            self.span = less
            self.states[c] = [cabac.AFTER_LESS[state], 1 - mps if state == 0 else mps]
        else:
            self.states[c] = [cabac.after_more(state), mps]
        self.renorm()


def test_ranges():
    table = cabac.range_table()
    assert table.shape == (64, 4)
    for state, row in {0: [128, 176, 208, 240], 1: [128, 167, 197, 227], 10: [85, 104, 123, 142], 33: [26, 31, 37, 43], 62: [6, 7, 8, 9], 63: [2, 2, 2, 2]}.items():
        assert table[state].tolist() == row


def test_bytes_are_those_of_the_bit_by_bit_coder_and_come_back():
    rng = np.random.default_rng(9)
    rows, width, contexts = 60, 90, 5
    n = rng.integers(0, width + 1, rows)
    ctx = rng.integers(0, contexts, (rows, width))
    ctx[rng.random(ctx.shape) < 0.2] = cabac.BYPASS
    bins = (rng.random((rows, width)) < rng.random((rows, 1))).astype(np.int64)
    end = rng.random(ctx.shape) < 0.05
    ctx[end], bins[end] = cabac.TERMINATE, 0
    pre = rng.integers(1, 127, (rows, contexts))
    got = cabac.encode(bins, ctx, n, pre)
    for i in range(rows):
        slow = SlowEncoder(pre[i].tolist())
        for j in range(n[i]):
            slow.write(int(bins[i, j]), int(ctx[i, j]))
        slow.write(1, cabac.TERMINATE)
        assert got[i] == packed(slow.bits)
    cursor = Cursor(pa.array(got))
    back = cabac.decode(cursor, np.concatenate([ctx, np.full((rows, 1), cabac.TERMINATE)], axis=1), n, pre)
    inside = np.arange(width)[None] < n[:, None]
    assert (back[:, :width][inside] == bins[inside]).all() and not cursor.fault.any()


def test_damage_is_an_error(spark):
    df = spark.createDataFrame([(b"\x80", [0] * 40, [64]), (b"\xff" * 9, [0] * 3, [0]), (b"\xff" * 9, [2], [64]), (None, [0], [64]), (b"", [], []), (b"\x12\x34\x56", [], [])], "d binary, c array<int>, p array<int>")
    got = df.select(cabac.decoded_bins(F.col("d"), F.col("c"), F.col("p")).alias("r")).collect()
    assert [r.r.err for r in got] == ["ended early", "invalid state", "invalid state", "ended early", "ended early", None]
    assert all(r.r.bins == [] for r in got)


def test_context_tables_are_checked(spark):
    slices = spark.createDataFrame([(0, 0, 26), (1, 2, 60), (9, 0, 1)], "ctx int, kind int, qp int")
    numbers = [(0, 0, 20, -15), (1, 2, 40, 54)]
    table = lambda rows: spark.createDataFrame(rows, "ctx int, kind int, m int, n int")
    got = {r.ctx: (r.pre, r.state, r.mps) for r in cabac.context_init(slices, table(numbers)).collect()}
    assert got[0] == (17, 46, 0) and got[1] == (126, 62, 1) and got[9][0] is None
    with pytest.raises(ValueError, match="1 rows"):
        cabac.context_init(slices, table([*numbers, (0, 0, 1, 1)]))


def test_range_lookups_out_of_bounds(spark):
    df = spark.createDataFrame([(0, 0), (33, 2), (64, 0), (-1, 0), (5, 4)], "s int, q int")
    assert [tuple(r[0]) for r in df.select(cabac.range_of_less(F.col("s"), F.col("q"))).collect()] == [(128, None), (37, None), (None, "invalid state"), (None, "invalid state"), (None, "invalid quarter")]
