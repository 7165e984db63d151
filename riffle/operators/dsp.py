"""PCM signals as arrays: scaling, down-mixing, decimation, short FIR filters, all as Column expressions; ``sound`` has the same for bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the flat-top window.
FLAT_TOP = (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)
# Step sizes and index changes of IMA ADPCM.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878,
    2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)


def floats(samples: Column) -> Column:
    return F.transform(samples, lambda s: s / F.lit(32768.0))


def quantised(values: Column) -> Column:
    """16-bit samples of values in [-1, 1], cut off towards zero."""
    return F.transform(values, lambda v: (v * 32767).cast("int"))


def amplified(samples: Column, factor: float) -> Column:
    return quantised(F.transform(floats(samples), lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * abs(factor)))))


def left_channel(samples: Column) -> Column:
    return F.filter(samples, lambda _, i: i % 2 == 0)


def block_mean(samples: Column, ratio: int) -> Column:
    """The mean of each ``ratio`` samples, cut off towards zero; a short tail goes."""
    if ratio < 1:
        raise ValueError("only whole ratios of 1 and more")
    n = F.floor(F.size(samples) / ratio).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: (F.aggregate(F.slice(samples, i * ratio + 1, F.lit(ratio)), F.lit(0).cast("long"), lambda a, s: a + s) / ratio).cast("int"))


def data_size(rate: Column, channels: Column, depth: Column, seconds: Column) -> Column:
    return (channels * rate * F.floor(depth / 8) * seconds).cast("long")


def _sinc(taps: int, cutoff: float, rate: float, high: bool) -> list[float]:
    if not 0 < cutoff < rate / 2:
        raise ValueError("cutoff frequency out of bounds")
    if taps <= 0:
        raise ValueError("a filter needs taps")
    f, out = cutoff / rate, [0.0] * (taps + 1)
    flat = lambda n: sum((-1) ** k * a * math.cos(2 * math.pi * k * n / taps) for k, a in enumerate(FLAT_TOP))
    for n in range(taps // 2):
        c = n - taps / 2
        out[n] = out[taps - n] = (-1 if high else 1) * math.sin(2 * math.pi * f * c) / (math.pi * c) * flat(n)
    out[taps // 2] = (1 - 2 * f if high else 2 * f) * flat(taps // 2)
    return out


def lowpass(taps: int, cutoff: float, rate: float) -> list[float]:
    return _sinc(taps, cutoff, rate, False)


def highpass(taps: int, cutoff: float, rate: float) -> list[float]:
    return _sinc(taps, cutoff, rate, True)


def bandpass(taps: int, low: float, high: float, rate: float) -> list[float]:
    """The high-pass of the lower edge after the low-pass of the upper one: one filter of twice the length."""
    a, b = highpass(taps, low, rate), lowpass(taps, high, rate)
    return [sum(a[k] * b[n - k] for k in range(len(a)) if 0 <= n - k < len(b)) for n in range(len(a) + len(b) - 1)]


def bandstop(taps: int, low: float, high: float, rate: float) -> list[float]:
    return [a + b for a, b in zip(lowpass(taps, low, rate), highpass(taps, high, rate), strict=True)]


def convolved(values: Column, coefficients: list[float]) -> Column:
    """The full linear convolution with a short filter, inside the row."""
    h = F.array(*map(F.lit, coefficients))
    m = len(coefficients)

    def at(n: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), F.lit(0.0), lambda a, k: a + F.get(h, k) * F.coalesce(F.get(values, n - k), F.lit(0.0)))

    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.size(values) + (m - 2)), at))


def adpcm_bytes(n: Column) -> Column:
    """Bytes of the chunk that ``n`` bytes of PCM become."""
    return F.floor((n - 2) / 4) + 8 + F.when(n % 4 == 0, 1).otherwise(0)
