"""Media columns: texts as 8-bit WAV, spectral-peak pair fingerprints (operator 3).

A payload is the text's UTF-8 bytes, padded with zeros to a positive multiple of 64, stored as
the samples of a mono 8-bit WAV written by the wave module. Reading takes the samples back with
the same module, makes a short-time Fourier transform (256 samples, a step of 128, Hann
window), keeps each band's strongest bin where it stands above the frame's mean and its
neighbours in time, and pairs each peak with the next three within 32 frames. A pair is stored
as one long: anchor frame << 32 | f1 << 16 | f2 << 8 | distance.

Null texts are empty (64 zero bytes). Equal texts give equal values; long ones are transformed
some hundred frames at a time. Repeated rows give repeated rows, an empty table an empty result, and
columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.tables import id_and_text, tidied

UNIT = 64
RATE = 8000
FRAME, STEP = 256, 128
#: First and last bins of the bands in which a frame's peaks are looked for.
BANDS = ((2, 12), (12, 28), (28, 60), (60, 129))
ABOVE_MEAN = 2.0
PARTNERS, REACH = 3, 32
_WINDOW = np.hanning(FRAME).astype(np.float32)
_BLOCK = 1024


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def _band_peaks(samples: np.ndarray, frames: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Strength and bin of each band's maximum for frames first to end; strength 0 if it isn't above the mean."""
    part = samples[first * STEP : (end - 1) * STEP + FRAME]
    view = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::STEP] * _WINDOW
    power = np.abs(np.fft.rfft(view, axis=1)).astype(np.float32)
    mean = power[:, BANDS[0][0] :].mean(axis=1) + 1e-6
    best = np.stack([power[:, a:b].argmax(axis=1) + a for a, b in BANDS], axis=1)
    strength = np.take_along_axis(power, best, axis=1)
    return np.where(strength >= ABOVE_MEAN * mean[:, None], np.round(strength, 2), 0), best


def fingerprint(payload: bytes) -> np.ndarray:
    """Time-coded peak pairs."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - 128.0
    # Zeros up to a whole number of steps, so that every sample is in a frame.
    if rest := max(FRAME - len(samples), -len(samples) % STEP):
        samples = np.concatenate([samples, np.zeros(rest, np.float32)])
    frames = (len(samples) - FRAME) // STEP + 1
    parts = [_band_peaks(samples, frames, i, min(i + _BLOCK, frames)) for i in range(0, frames, _BLOCK)]
    strength, best = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    edge = np.zeros((1, len(BANDS)), strength.dtype)
    peak = (strength > 0) & (strength > np.concatenate([edge, strength[:-1]])) & (strength >= np.concatenate([strength[1:], edge]))
    t, band = np.nonzero(peak)
    f = best[t, band]
    out = []
    for k in range(1, PARTNERS + 1):
        gap = t[k:] - t[:-k]
        near = gap <= REACH
        out.append((t[:-k].astype(np.int64) << 32 | f[:-k] << 16 | f[k:] << 8 | gap)[near])
    return np.sort(np.concatenate(out))


#: Rows that are held at a time, whatever the size of Arrow's batches.
_ROWS = 200
_READ = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
_READ_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>"


def _features(stored: list[bytes]) -> list[pa.Array]:
    """The columns of _READ, from stored files alone."""
    rows = []
    for data in stored:
        payload = from_wav(data)
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), fingerprint(payload)))
    return [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)]


def _store(texts: pa.Array) -> tuple[pa.Array, list[bytes]]:
    raw = texts.cast(pa.binary()).to_pylist()
    return pa.array(map(len, raw), pa.int64()), [to_wav(padded(x)) for x in raw]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            yield batch.slice(at, _ROWS)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a WAV file in a binary column)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sizes, stored = _store(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(tidied(store), "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digests of the samples read back and of the stored form, and the fingerprint."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_features(part.column(2).to_pylist())], ["doc_id", "n_bytes", *_READ])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidied(read), f"doc_id long, n_bytes long, {_READ_SCHEMA}")


def media_features(docs: DataFrame, keep: bool = False) -> DataFrame:
    """read_media(to_media(docs)) in one pass, so that files needn't leave the worker that wrote them; with keep, the files (column media) too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sizes, stored = _store(part.column(1))
            columns = [part.column(0), sizes, *_features(stored)] + [pa.array(stored, pa.binary())] * keep
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", *_READ] + ["media"] * keep)

    return id_and_text(docs).mapInArrow(tidied(run), f"doc_id long, n_bytes long, {_READ_SCHEMA}" + ", media binary" * keep)
