"""Media columns: texts stored as 8-bit sound, and audio features as fixed-shape Arrow tensors with time spans.

The bytes of a text, filled up with zeros to a multiple of 64, are the samples of an 8-bit mono WAVE file, which is kept as
a binary column. Features come from the stored bytes, read back: the sound is resampled by a polyphase filter, cut
into overlapping frames, turned into log-mel bands, and active spans are found by energy with hysteresis (a span opens
above the upper threshold and closes below the lower one). The result is an Arrow stream of one batch for each sound: a
fixed-shape tensor of WINDOW frames by MELS bands for each window, its time span, and the active spans inside it.

Long sounds are worked through window by window, so memory follows the stored bytes and not the spectra. Every
window is computed alone, with the same shapes, so equal texts give equal values wherever they are.

Defined results: a null text is an empty text, stored as 64 zero samples; the last window is filled up with silence and its span
ends with the sound; rows with a null id come back with a null id; repeated rows repeat; an empty table gives an empty
result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.session import table

ALIGN = 64
RATE, UP, DOWN = 16_000, 3, 4
#: Of the resampled sound: samples in a frame and between frames, bands, frames in a window, length of the FFT.
FRAME, HOP, MELS, WINDOW, FFT = 300, 120, 20, 32, 512
#: Filter taps on either side for each phase; energies in dB where a span opens and closes.
TAPS, OPEN_DB, CLOSE_DB = 8, -9.0, -12.0
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
SCHEMA = pa.schema([("mel", pa.fixed_shape_tensor(pa.float16(), [WINDOW, MELS])), ("start_s", pa.float64()), ("end_s", pa.float64()), ("active", pa.list_(pa.list_(pa.float64(), 2)))])


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % ALIGN or (0 if data else ALIGN)), len(data)


def wave_of(payload: bytes) -> bytes:
    n = len(payload)
    return HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples_of(wave: bytes) -> bytes:
    """The payload of a stored WAVE file, found by walking its chunks."""
    if wave[:4] != b"RIFF" or wave[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(wave):
        name, size = struct.unpack_from("<4sI", wave, at)
        if name == b"data":
            return wave[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(1)
def polyphase() -> np.ndarray:
    """The windowed-sinc low-pass, one row of taps for each of the UP phases."""
    m = max(UP, DOWN)
    t = np.arange(-TAPS * m, TAPS * m + UP)
    h = np.sinc(t / m) / m * np.kaiser(len(t), 8.0) * UP
    return np.pad(h, (0, -len(h) % UP)).reshape(-1, UP).T.copy()


@lru_cache(1)
def mel_bank() -> np.ndarray:
    """Triangles that are equally wide on the mel scale, over the bins of the FFT."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    rise = (f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    fall = (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def resample(sound: np.ndarray, first: int, n: int) -> np.ndarray:
    """Samples first .. first + n of the resampled sound: each is one phase of the filter over the input around it."""
    taps = polyphase()
    width = taps.shape[1]
    at = (first + np.arange(n)) * DOWN
    base, phase = at // UP, at % UP
    low = int(base[0]) - width // 2
    span = int(base[-1]) - low + width
    part = np.zeros(span, np.float32)
    a, b = max(0, low), min(len(sound), low + span)
    if b > a:
        part[a - low : b - low] = (sound[a:b].astype(np.float32) - 128) / 128
    near = np.lib.stride_tricks.sliding_window_view(part, width)
    out = np.empty(n, np.float32)
    for i in range(min(UP, n)):  # every UP-th sample has the same phase, DOWN samples of the input further on
        out[i::UP] = near[base[i] - base[0] :: DOWN][: len(out[i::UP])] @ np.ascontiguousarray(taps[phase[i], ::-1], np.float32)
    return out


def active_spans(energy: np.ndarray, open_: bool) -> tuple[list[tuple[int, int]], bool]:
    """Runs of frames between opening and closing thresholds; a span may come in open and go out open."""
    above, below = energy >= OPEN_DB, energy < CLOSE_DB
    mark = np.where(above, 1, np.where(below, -1, 0))
    known = np.where(mark != 0, np.arange(len(mark)), -1)
    last = np.maximum.accumulate(known)
    on = np.where(last < 0, open_, mark[last] > 0)
    step = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True)), bool(on[-1])


def features(payload: bytes) -> tuple[bytes, int, int, str]:
    """The Arrow stream of one sound, its windows, its active frames, and a digest.

    The digest is over the spans, in frames, and the level of each band over the whole sound, in tenths. Tensors are no part of
    it, as their last digits depend on how a processor adds up.
    """
    sound = np.frombuffer(payload, np.uint8)
    rate = RATE * UP / DOWN
    total = -(-len(sound) * UP // DOWN)
    frames = max(1, -(-max(0, total - FRAME) // HOP) + 1)
    windows = -(-frames // WINDOW)
    hann = np.hanning(FRAME).astype(np.float32)
    bank = mel_bank().astype(np.float32)
    mel, spans, open_, active, levels = [], [], False, 0, np.zeros(MELS)
    digest = hashlib.sha256()
    for w in range(windows):
        part = resample(sound, w * WINDOW * HOP, (WINDOW - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(cut * hann, FFT)) ** 2
        bands = np.log10(power.astype(np.float32) @ bank + 1e-6)
        mel.append(bands.astype(np.float16).ravel())
        here = min(WINDOW, frames - w * WINDOW)
        levels += bands[:here].sum(axis=0, dtype=float)
        energy = 10 * np.log10((cut[:here] ** 2).mean(axis=1) + 1e-9)
        runs, open_ = active_spans(energy, open_)
        active += sum(b - a for a, b in runs)
        digest.update(repr((w, runs)).encode())
        spans.append([[(w * WINDOW + a) * HOP / rate, (w * WINDOW + b) * HOP / rate] for a, b in runs])
    start = np.arange(windows) * WINDOW * HOP / rate
    end = np.minimum(start + ((WINDOW - 1) * HOP + FRAME) / rate, total / rate)
    values = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(mel)), WINDOW * MELS)
    columns = [pa.ExtensionArray.from_storage(SCHEMA.field("mel").type, values), pa.array(start), pa.array(end), pa.array(spans, SCHEMA.field("active").type)]
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, SCHEMA) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=SCHEMA))
    digest.update(repr(np.rint(10 * levels / frames).astype(int).tolist()).encode())
    return sink.getvalue(), windows, active, digest.hexdigest()


def read_tensors(stream: bytes) -> pa.Table:
    """The windows of one sound: ``mel`` (tensor), ``start_s``, ``end_s``, ``active`` (time spans)."""
    return pa.ipc.open_stream(stream).read_all()


MEDIA = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, tensors binary, n_windows int, active_frames int, digest string"
#: Bytes of stored sound that a task gives on at a time.
OUT = 8 << 20


def media_columns(docs: DataFrame) -> DataFrame:
    """One row for each document: the stored sound, what was read back from it, and its tensors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                payload, n = payload_of(text.as_py())
                media = wave_of(payload)
                back = samples_of(media)
                tensors, windows, active, digest = features(back)
                rows.append((doc, n, media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), tensors, windows, active, digest))
                held += len(media)
                if held > OUT:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)

    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in MEDIA.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MEDIA)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_windows").cast("string"), F.col("active_frames").cast("string"), "digest").alias("feature"), "n_windows", "active_frames",
    )


QUERIES = {"op3_media_columns": op3_media_columns}
ORACLES: dict[str, str] = {}
