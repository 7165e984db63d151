import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import functions as F

from riffle.llm import audio
from riffle.llm.audio import FRAME, HOP, MELS, WINDOW, active_spans, features, media_columns, mel_bank, op3_media_columns, payload_of, read_tensors, resample, samples_of, wave_of

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "é🙂" * 40, "lorem ipsum\n" * 9000, "lorem ipsum\n" * 9000]


def frame(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "n", 2)], "doc_id long, text string, media int")


def test_round_trip_and_digests(spark):
    rows = {r.doc_id: r for r in media_columns(frame(spark)).collect()}
    assert len(rows) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(1 << 30)) == (1, 1, 16_000, payload)
    assert rows[6].digest == rows[7].digest != rows[5].digest
    assert rows[6].tensors == rows[7].tensors and rows[0].tensors == rows[1].tensors
    assert media_columns(frame(spark).where(F.lit(False))).count() == 0


def test_tensors_and_spans():
    t = read_tensors(features(payload_of(TEXTS[6])[0])[0])
    assert t.schema.field("mel").type.shape == [WINDOW, MELS]
    start, end = t["start_s"].to_numpy(), t["end_s"].to_numpy()
    assert start[0] == 0 and (end[:-1] > start[1:]).all() and end[-1] == len(payload_of(TEXTS[6])[0]) / 16_000
    assert np.isfinite(t["mel"].combine_chunks().storage.flatten().to_numpy().astype(float)).all()


def test_resampling_by_phases_equals_the_whole_convolution(monkeypatch):
    sound = np.random.default_rng(0).integers(0, 256, 3000).astype(np.uint8)
    for up, down in ((3, 4), (1, 2), (2, 3), (5, 3)):
        monkeypatch.setattr(audio, "UP", up)
        monkeypatch.setattr(audio, "DOWN", down)
        audio.polyphase.cache_clear()
        taps = audio.polyphase()
        n = len(sound) * up // down
        whole = resample(sound, 0, n)
        x = (sound.astype(float) - 128) / 128
        for m in (0, 1, 7, n // 2, n - 1):
            base, phase = m * down // up, m * down % up
            want = sum(taps[phase, ::-1][k] * x[base - taps.shape[1] // 2 + k] for k in range(taps.shape[1]) if 0 <= base - taps.shape[1] // 2 + k < len(x))
            assert abs(whole[m] - want) < 1e-4
        assert np.abs(resample(sound, 100, 50) - whole[100:150]).max() < 1e-6
    audio.polyphase.cache_clear()


def test_a_tone_lights_its_band():
    n = np.arange(20_000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * n / 16_000)).astype(np.uint8)
    mel = read_tensors(features(tone.tobytes())[0])["mel"].combine_chunks().storage.flatten().to_numpy().astype(float).reshape(-1, MELS)
    want = int(np.argmax(mel_bank()[round(1000 * audio.FFT / 12_000)]))
    assert abs(int(np.argmax(mel[10])) - want) <= 1
    assert FRAME > HOP


def slow_windows(payload):
    """Mel bands and active frames of a sound, sample by sample and bin by bin, in double precision."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    taps, total = audio.polyphase(), -(-len(x) * audio.UP // audio.DOWN)
    width, frames = taps.shape[1], max(1, -(-max(0, total - FRAME) // HOP) + 1)
    y = np.zeros((-(-frames // WINDOW) * WINDOW - 1) * HOP + FRAME)
    for m in range(len(y)):
        base, phase = m * audio.DOWN // audio.UP, m * audio.DOWN % audio.UP
        low = base - width // 2
        y[m] = sum(taps[phase, ::-1][k] * x[low + k] for k in range(width) if 0 <= low + k < len(x))
    n, bins = np.arange(FRAME), np.arange(audio.FFT // 2 + 1)
    wave = np.exp(-2j * np.pi * np.outer(bins, n) / audio.FFT)
    mels, on, active = [], False, []
    for f in range((len(y) - FRAME) // HOP + 1):
        part = y[f * HOP : f * HOP + FRAME]
        power = np.abs(wave @ (part * (0.5 - 0.5 * np.cos(2 * np.pi * n / (FRAME - 1))))) ** 2
        mels.append(np.log10(power @ mel_bank() + 1e-6))
        energy = 10 * np.log10((part**2).mean() + 1e-9)
        on = energy >= audio.OPEN_DB or on and energy >= audio.CLOSE_DB
        if f < frames:
            active.append(on)
    return np.array(mels), active


def test_tensors_against_a_slow_version():
    rng = np.random.default_rng(6)
    quiet, loud = rng.integers(118, 138, 900), rng.integers(0, 256, 1_500)
    for payload in (bytes(64), b"lorem ipsum dolor sit amet " * 40 + bytes(8), np.concatenate([quiet, loud, quiet, loud]).astype(np.uint8).tobytes()):
        stream, windows, active, _ = features(payload)
        t = read_tensors(stream)
        got = t["mel"].combine_chunks().storage.flatten().to_numpy().astype(float).reshape(-1, MELS)
        want, on = slow_windows(payload)
        assert len(got) == len(want) == windows * WINDOW
        assert np.abs(got - want).max() < 0.02  # tensors have half precision
        assert active == sum(on)
        frames = [False] * len(on)
        for a, b in (s for w in t["active"].to_pylist() for s in w):
            for f in range(round(a * 12_000 / HOP), round(b * 12_000 / HOP)):
                frames[f] = True
        assert frames == [bool(x) for x in on]


def test_hysteresis():
    assert active_spans(np.array([-20, -8, -10, -11, -13, -10, -8.0]), False) == ([(1, 4), (6, 7)], True)
    assert active_spans(np.array([-10.0, -11, -13]), True) == ([(0, 2)], False)
    assert samples_of(wave_of(b"ab" * 32)) == b"ab" * 32


def test_on_the_table(spark):
    rows = op3_media_columns(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.media_bytes == r.payload_bytes + 44 for r in rows)
