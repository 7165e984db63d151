"""Sound as bytes: 16-bit little-endian PCM, IMA ADPCM chunks, WAVE files, and jobs from a folder of files to another.

Functions give a struct ``err, data`` or ``err, values``: where bytes are not sound, ``err`` says why and the rest is null. The recursive
coder is an Arrow kernel: it moves through all rows of a batch at once, one sample of each at a time, so its work is
linear in the samples.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle.functions.bytesx import put_le
from riffle.operators.dsp import INDEX, STEPS

#: Bytes of a chunk's head: length, first sample, step index and padding flag.
HEAD = 8
PCM_FORMAT = 1


def format_depth(name: Column) -> Column:
    """Bits of a sample format; null for a name that is none."""
    return F.when(name == "S16_LE", 16).when(name == "S32_LE", 32)


def format_name(depth: Column) -> Column:
    return F.when(depth == 16, "S16_LE").when(depth == 32, "S32_LE")


def _problem(data: Column) -> Column:
    return F.when(data.isNull() | (F.octet_length(data) == 0), "no audio data").when(F.octet_length(data) % 2 != 0, "uneven number of bytes")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _floats(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else np.frombuffer(d, "<i2") / 32768.0)


@F.pandas_udf(T.BinaryType())
def _samples(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else np.clip(np.trunc(np.asarray(v, np.float64) * 32767), -32768, 32767).astype("<i2").tobytes())


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _integers(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else np.frombuffer(d, "<i2").astype(np.int32))


def pcm_samples(data: Column) -> Column:
    """``err, values``: samples as whole numbers."""
    err = _problem(data)
    return F.struct(err.alias("err"), _integers(F.when(err.isNull(), data)).alias("values"))


def pcm_floats(data: Column) -> Column:
    """``err, values``: samples as numbers in [-1, 1)."""
    err = _problem(data)
    return F.struct(err.alias("err"), _floats(F.when(err.isNull(), data)).alias("values"))


def pcm_bytes(values: Column) -> Column:
    """``err, data``: numbers as samples, cut off towards zero; beyond the range, the ends of it."""
    err = F.when(values.isNull() | (F.size(values) == 0), "no audio data")
    return F.struct(err.alias("err"), _samples(F.when(err.isNull(), values)).alias("data"))


def filtered(data: Column, coefficients: list[float]) -> Column:
    """``err, data``: PCM after a filter of any length, by Fourier transform where that is cheaper."""
    h = np.asarray(coefficients, np.float64)

    @F.pandas_udf(T.BinaryType())
    def run(column: pd.Series) -> pd.Series:
        def one(d):
            if d is None:
                return None
            x = np.frombuffer(d, "<i2") / 32768.0
            n = len(x) + len(h) - 1
            y = np.convolve(x, h) if min(len(x), len(h)) < 64 else np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)
            return np.clip(np.trunc(y * 32767), -32768, 32767).astype("<i2").tobytes()

        return column.map(one)

    err = _problem(data)
    return F.struct(err.alias("err"), run(F.when(err.isNull(), data)).alias("data"))


def resampled(data: Column, channels: int, ratio: int) -> Column:
    """``err, data``: each ``ratio`` frames as their mean, cut off towards zero, for every channel by itself; a short tail goes."""
    if ratio < 1 or channels < 1:
        raise ValueError("ratio and channels are whole numbers of 1 and more")

    @F.pandas_udf(T.BinaryType())
    def run(column: pd.Series) -> pd.Series:
        def one(d):
            if d is None:
                return None
            x = np.frombuffer(d, "<i2").astype(np.int64)
            x = x[: len(x) // (channels * ratio) * channels * ratio].reshape(-1, ratio, channels)
            return np.trunc(x.sum(axis=1) / ratio).astype("<i2").tobytes()

        return column.map(one)

    err = F.coalesce(_problem(data), F.when(F.octet_length(data) % (2 * channels) != 0, "last frame is not whole"))
    return F.struct(err.alias("err"), run(F.when(err.isNull(), data)).alias("data"))


def mono(data: Column) -> Column:
    """``err, data``: the left channel of stereo sound."""

    @F.pandas_udf(T.BinaryType())
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda d: None if d is None else np.frombuffer(d, "<i2")[::2].tobytes())

    err = F.coalesce(_problem(data), F.when(F.octet_length(data) % 4 != 0, "last frame is not whole"))
    return F.struct(err.alias("err"), run(F.when(err.isNull(), data)).alias("data"))


def _move(est: np.ndarray, index: np.ndarray, nibble: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What encoder and decoder both do with a nibble."""
    diff = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    diff = np.minimum(diff, 32767)
    est = np.clip(est + np.where(nibble & 8, -diff, diff), -32768, 32767)
    return est, np.clip(index + np.array(INDEX)[nibble & 7], 0, len(STEPS) - 1)


def _together(sizes: np.ndarray):
    """Sequences from the longest to the shortest: where each begins in one flat array, and for each position how many have it."""
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    down = sizes[order]
    return order, start, lambda i: int(np.searchsorted(-down, -i, side="left"))


def encode_chunks(pcm: list[np.ndarray]) -> list[bytes]:
    """A chunk of each sequence of two samples or more."""
    if not pcm:
        return []
    steps = np.array(STEPS)
    sizes = np.array([len(x) for x in pcm])
    flat = np.concatenate(pcm).astype(np.int64)
    order, start, having = _together(sizes)
    est = flat[start]
    half = np.abs(np.abs(est) - np.abs(flat[start + 1]) / 2)
    index = np.abs(steps[None, :] - half[:, None]).argmin(axis=1)
    first = index.copy()
    nibbles = np.zeros(len(flat), np.uint8)
    for i in range(1, int(sizes.max())):
        m = having(i)
        at, size = start[:m] + i, steps[index[:m]]
        delta = np.clip(flat[at] - est[:m], -32768, 32767)
        left, nibble = np.abs(delta), np.where(delta < 0, 8, 0)
        for bit, part in ((4, size), (2, size >> 1), (1, size >> 2)):
            over = left > part
            nibble = nibble + np.where(over, bit, 0)
            left = left - np.where(over, part, 0)
        est[:m], index[:m] = _move(est[:m], index[:m], nibble, size)
        nibbles[at] = nibble
    out: list[bytes] = [b""] * len(pcm)
    for row, a, i in zip(order.tolist(), start.tolist(), first.tolist(), strict=True):
        own = nibbles[a + 1 : a + sizes[row]]
        odd = len(own) % 2
        own = np.append(own, np.zeros(odd, np.uint8)).reshape(-1, 2)
        body = (own[:, 1] << 4 | own[:, 0]).astype(np.uint8).tobytes()
        out[row] = (HEAD + len(body)).to_bytes(4, "little") + int(flat[a]).to_bytes(2, "little", signed=True) + bytes([i, odd]) + body
    return out


def decode_chunks(chunks: list[bytes]) -> list[np.ndarray]:
    """The samples of each chunk."""
    if not chunks:
        return []
    steps = np.array(STEPS)
    parts = []
    for c in chunks:
        body = np.frombuffer(c, np.uint8, offset=HEAD)
        parts.append(np.stack([body & 15, body >> 4], axis=1).ravel()[: 2 * len(body) - (c[7] == 1)].astype(np.int64))
    sizes = np.array([len(p) for p in parts])
    flat = np.concatenate(parts)
    order, start, having = _together(sizes)
    est = np.array([int.from_bytes(c[4:6], "little", signed=True) for c in chunks])[order]
    index = np.minimum(np.array([c[6] for c in chunks])[order], len(STEPS) - 1)
    first, out = est.copy(), np.zeros(len(flat), np.int64)
    for i in range(int(sizes.max(initial=0))):
        m = having(i) if i else int((sizes > 0).sum())
        at = start[:m] + i
        est[:m], index[:m] = _move(est[:m], index[:m], flat[at], steps[index[:m]])
        out[at] = est[:m]
    done: list[np.ndarray] = [np.zeros(0)] * len(chunks)
    for row, a, x in zip(order.tolist(), start.tolist(), first.tolist(), strict=True):
        done[row] = np.concatenate([[x], out[a : a + sizes[row]]])
    return done


def split_chunks(data: bytes) -> list[bytes]:
    """Chunks one after another, each with its length in front; what is not a whole chunk at the end is left out."""
    out, at = [], 0
    while at + HEAD <= len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        if size < HEAD or at + size > len(data):
            break
        out.append(data[at : at + size])
        at += size
    return out


@F.pandas_udf(T.BinaryType())
def _encoded(data: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(data), index=data.index, dtype=object)
    some = data.dropna()
    out.loc[some.index] = pd.Series(encode_chunks([np.frombuffer(d, "<i2") for d in some]), index=some.index, dtype=object)
    return out


@F.pandas_udf(T.BinaryType())
def _decoded(data: pd.Series) -> pd.Series:
    whole = [[] if d is None else split_chunks(d) for d in data]
    samples = iter(decode_chunks([c for chunks in whole for c in chunks]))
    return pd.Series([None if d is None else np.concatenate([np.zeros(0), *[next(samples) for _ in chunks]]).astype("<i2").tobytes() for d, chunks in zip(data, whole, strict=True)], dtype=object)


def adpcm_encoded(data: Column) -> Column:
    """``err, data``: PCM as one ADPCM chunk; two samples at least."""
    err = F.coalesce(_problem(data), F.when(F.octet_length(data) < 4, "fewer than two samples"))
    return F.struct(err.alias("err"), _encoded(F.when(err.isNull(), data)).alias("data"))


def adpcm_decoded(data: Column) -> Column:
    """``err, data``: ADPCM chunks, one after another, as PCM."""
    err = F.when(data.isNull() | (F.octet_length(data) < HEAD), "no whole chunk")
    return F.struct(err.alias("err"), _decoded(F.when(err.isNull(), data)).alias("data"))


def wave(data: Column, form: Column, channels: Column, rate: Column, depth: Column) -> Column:
    """``err, data``: a WAVE file of PCM. The first thing that is wrong, in the order format, channels, rate, depth, is the error."""
    err = F.when(form != PCM_FORMAT, "invalid audio format").when(channels == 0, "invalid number of channels").when(rate == 0, "invalid sample rate").when(depth == 0, "invalid bit depth")
    n = F.octet_length(data)
    text = lambda t: F.hex(F.lit(t))
    frame = channels.cast("long") * depth
    byte_rate, block = F.floor(rate.cast("long") * frame / 8), F.floor(frame / 8)
    head = F.concat(text("RIFF"), put_le(n + 36, 4), text("WAVEfmt "), put_le(F.lit(16), 4), put_le(F.lit(PCM_FORMAT), 2), put_le(channels, 2), put_le(rate, 4), put_le(byte_rate, 4), put_le(block, 2), put_le(depth, 2), text("data"), put_le(n, 4))
    return F.struct(err.alias("err"), F.when(err.isNull(), F.concat(F.unhex(head), data)).alias("data"))


def convert_files(spark: SparkSession, source: str, target: str, convert: Callable[[Column], Column], glob: str = "*") -> DataFrame:
    """Every file of ``source`` through one of the functions above into a file of the same name below ``target``. Gives ``name, err``; files with an error are not written."""
    from riffle.session import cut
    from riffle.sources.files import whole_files, write_bytes

    name = F.element_at(F.split("path", "/"), -1)
    rows = cut(whole_files(spark, source, glob).select(name.alias("name"), convert(F.col("data")).alias("r")))
    write_bytes(rows.where("r.err IS NULL").select("name", "r.data"), target)
    return rows.select("name", "r.err")
