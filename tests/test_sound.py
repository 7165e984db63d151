import numpy as np
import pytest
from pyspark.sql import functions as F

from riffle.operators import dsp, sound


def run(spark, rows, f):
    df = spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(rows)], "i int, d binary")
    return [r.r for r in df.select("i", f(F.col("d")).alias("r")).orderBy("i").collect()]


def pcm(*samples):
    return np.array(samples, "<i2").tobytes()


def test_numbers_and_back(spark):
    rows = [pcm(0, 16384, -32768, 32767), b"", None, b"abc", pcm(5)]
    got = run(spark, rows, sound.pcm_floats)
    assert [r.err for r in got] == [None, "no audio data", "no audio data", "uneven number of bytes", None]
    assert got[0]["values"] == [0, 0.5, -1, 32767 / 32768] and got[1]["values"] is None
    back = spark.createDataFrame([([0.0, 0.5, -1.0, 1.5, -0.00001],), ([],), (None,)], "v array<double>").select(sound.pcm_bytes(F.col("v")).alias("r")).collect()
    assert bytes(back[0].r.data) == pcm(0, 16383, -32767, 32767, 0) and back[1].r.err == back[2].r.err == "no audio data"


def slow_chunk(samples):
    """One sample after another, as the format describes it."""
    steps, moves = dsp.STEPS, dsp.INDEX
    half = abs(abs(samples[0]) - abs(samples[1]) / 2)
    index = min(range(len(steps)), key=lambda i: (abs(steps[i] - half), i))
    est, head, nibs, decoded = samples[0], index, [], [samples[0]]
    cap = lambda v: max(-32768, min(32767, v))
    for s in samples[1:]:
        delta, step = cap(s - est), steps[index]
        nib, left, diff = (8 if delta < 0 else 0), abs(delta), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            if left > part:
                nib, left, diff = nib | bit, left - part, diff + part
        est = cap(est + (-1 if nib & 8 else 1) * min(diff, 32767))
        index = max(0, min(len(steps) - 1, index + moves[nib & 7]))
        nibs.append(nib)
        decoded.append(est)
    odd = len(nibs) % 2
    body = bytes(a | b << 4 for a, b in zip(nibs[::2], nibs[1::2] + [0] * odd, strict=True))
    return (8 + len(body)).to_bytes(4, "little") + samples[0].to_bytes(2, "little", signed=True) + bytes([head, odd]) + body, decoded


def test_chunks_against_a_slow_coder(spark):
    rng = np.random.default_rng(0)
    rows = [np.cumsum(rng.integers(-900, 900, n)).astype("<i2") for n in (2, 3, 4, 5, 64, 301, 1000)] + [np.array([32767, -32768] * 20, "<i2"), np.array([-32768, 32767, 0], "<i2")]
    coded = run(spark, [r.tobytes() for r in rows] + [b"ab", b"", b"abc"], sound.adpcm_encoded)
    assert [r.err for r in coded[-3:]] == ["fewer than two samples", "no audio data", "uneven number of bytes"]
    for r, own in zip(rows, coded, strict=False):
        chunk, decoded = slow_chunk(r.astype(int).tolist())
        assert bytes(own.data) == chunk and sound.decode_chunks([chunk])[0].tolist() == decoded
    long = run(spark, [b"".join(bytes(c.data) for c in coded[:9]) + b"\x40\0\0\0cut", b"short"], sound.adpcm_decoded)
    whole = np.concatenate(sound.decode_chunks([bytes(c.data) for c in coded[:9]])).astype("<i2").tobytes()
    assert bytes(long[0].data) == whole and len(whole) == 2 * sum(map(len, rows)) and long[1].err == "no whole chunk"


def test_a_long_filter(spark):
    x = (np.sin(np.arange(9000) / 3) * 12000).astype("<i2")
    h = dsp.lowpass(500, 900.0, 8000)
    (got,) = run(spark, [x.tobytes()], lambda d: sound.filtered(d, h))
    want = np.trunc(np.clip(np.convolve(x / 32768, h) * 32767, -32768, 32767))
    assert np.abs(np.frombuffer(got.data, "<i2") - want).max() <= 1


def test_resampling_and_one_channel(spark):
    x = pcm(1, -10, 2, -20, 6, -33, 7, 7)
    assert bytes(run(spark, [x], lambda d: sound.resampled(d, 2, 3))[0].data) == pcm(3, -21)
    assert bytes(run(spark, [x], sound.mono)[0].data) == pcm(1, 2, 6, 7)
    assert [r.err for r in run(spark, [b"abcdef", b"", b"abc"], sound.mono)] == ["last frame is not whole", "no audio data", "uneven number of bytes"]
    with pytest.raises(ValueError):
        sound.resampled(F.col("d"), 1, 0)


# Formats and what is wrong with them.
WAVE_CASES = [(1, 1, 44100, 16, None), (0, 1, 44100, 16, "invalid audio format"), (1, 0, 44100, 16, "invalid number of channels"), (1, 1, 0, 16, "invalid sample rate"), (1, 1, 44100, 0, "invalid bit depth"), (2, 0, 0, 0, "invalid audio format")]


def test_wave_files_and_their_errors(spark):
    import io
    import wave

    df = spark.createDataFrame([(*c[:4], bytearray(pcm(1, -2, 3))) for c in WAVE_CASES], "form int, channels int, rate int, depth int, d binary")
    got = [r.w for r in df.select(sound.wave(F.col("d"), F.col("form"), F.col("channels"), F.col("rate"), F.col("depth")).alias("w")).collect()]
    assert [r.err for r in got] == [c[4] for c in WAVE_CASES] and all((r.data is None) == (r.err is not None) for r in got)
    with wave.open(io.BytesIO(bytes(got[0].data))) as f:
        assert (f.getnchannels(), f.getframerate(), f.getsampwidth(), f.readframes(9)) == (1, 44100, 2, pcm(1, -2, 3))


def test_file_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sounds = {"a.pcm": pcm(*range(0, 4000, 40)), "b.pcm": pcm(-5, 5), "bad.pcm": b"xyz"}
    for name, data in sounds.items():
        (tmp_path / "in" / name).write_bytes(data)
    jobs = {"coded": ("in", sound.adpcm_encoded), "plain": ("coded", sound.adpcm_decoded), "small": ("in", lambda d: sound.resampled(d, 1, 2)), "left": ("in", sound.mono)}
    for target, (source, f) in jobs.items():
        errors = {r.name: r.err for r in sound.convert_files(spark, str(tmp_path / source), str(tmp_path / target), f).collect()}
        assert set(errors) == {p.name for p in (tmp_path / source).iterdir()}
        assert {p.name for p in (tmp_path / target).iterdir()} == {n for n, e in errors.items() if e is None}
    assert len((tmp_path / "plain" / "a.pcm").read_bytes()) == 200 and (tmp_path / "left" / "b.pcm").read_bytes() == pcm(-5)
    assert (tmp_path / "small" / "b.pcm").read_bytes() == pcm(0)


def test_format_names(spark):
    df = spark.createDataFrame([("S16_LE",), ("S32_LE",), ("U8",)], "n string").select(sound.format_depth(F.col("n")).alias("d"))
    assert [(r.d, r.n) for r in df.select("d", sound.format_name(F.col("d")).alias("n")).collect()] == [(16, "S16_LE"), (32, "S32_LE"), (None, None)]
