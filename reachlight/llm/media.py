"""Media columns: WAV bytes, their short-time Fourier transform, and fingerprints from pairs of spectral peaks."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reachlight.llm import frame

#: Samples in a frame of the transform, and from one frame to the next.
FRAME, HOP = 256, 128
#: A peak is the greatest value in its neighbourhood of so many frames and bins to each side, and FLOOR times the mean.
NEAR_FRAMES, NEAR_BINS, FLOOR = 2, 8, 4.0
_AROUND = [(t, f) for t in range(-NEAR_FRAMES, NEAR_FRAMES + 1) for f in range(-NEAR_BINS, NEAR_BINS + 1) if t or f]
RINGS = [np.array([x for x in _AROUND if (max(map(abs, x)) <= 1) == near]) for near in (True, False)]
#: A peak is paired with so many later ones at most, from 1 to REACH frames on.
FAN_OUT, REACH = 3, 63
#: Frames that are transformed at once.
BLOCK = 4096

SCHEMA = "doc_id long, rate int, channels int, samples long, seconds double, times array<int>, hashes array<int>, error string"


def wav_bytes(samples: np.ndarray, rate: int = 8000) -> bytes:
    """A mono WAV file: 8-bit unsigned or 16-bit samples, by the array's type."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(samples.dtype.itemsize)
        w.setframerate(rate)
        w.writeframes(samples.tobytes())
    return out.getvalue()


def read_wav(data: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, samples in [-1, 1], channels averaged). Raises wave.Error or EOFError if it isn't PCM WAV."""
    with wave.open(io.BytesIO(data), "rb") as w:
        rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
        raw = w.readframes(n)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / (1 << 23)
    elif width == 4:
        x = np.frombuffer(raw, "<i4").astype(np.float32) / 2**31
    else:
        raise wave.Error(f"{width} bytes a sample")
    return rate, channels, x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


def stft(x: np.ndarray) -> Iterator[np.ndarray]:
    """Powers, (frames, FRAME / 2) in blocks; the last frame is filled with zeros. The mean bin is left out."""
    if not len(x):
        return
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for i in range(0, frames, BLOCK):
        spectrum = np.fft.rfft(views[i : i + BLOCK] * WINDOW, axis=1)[:, 1:]
        yield spectrum.real**2 + spectrum.imag**2


WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bins) of the spectral peaks, by frame and then bin. Of equal values in one neighbourhood all count."""
    blocks = list(stft(x))
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    power = np.concatenate(blocks) if len(blocks) > 1 else blocks[0]
    wide = np.zeros((power.shape[0] + 2 * NEAR_FRAMES, power.shape[1] + 2 * NEAR_BINS), np.float32)
    wide[NEAR_FRAMES:-NEAR_FRAMES, NEAR_BINS:-NEAR_BINS] = power
    # few cells exceed the floor and their next neighbours; the whole neighbourhood is looked at for these alone
    t, f = np.nonzero(power > FLOOR * power.mean())
    at = (t + NEAR_FRAMES) * wide.shape[1] + f + NEAR_BINS
    flat = wide.ravel()
    for ring in RINGS:
        around = ring[:, 0] * wide.shape[1] + ring[:, 1]
        for i in range(0, max(1, len(at)), BLOCK):
            at[i : i + BLOCK] *= flat[at[i : i + BLOCK, None] + around].max(axis=1) <= flat[at[i : i + BLOCK]]
        at = at[at > 0]
    t, f = np.divmod(at, wide.shape[1])
    return t - NEAR_FRAMES, f - NEAR_BINS


def fingerprint(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, hashes): for each pair of peaks the earlier frame, and bin 1, bin 2 and distance packed in 24 bits."""
    t, f = peaks(x)
    times, hashes = [], []
    later = np.searchsorted(t, t, "right")  # peaks of one frame don't pair; each has the first FAN_OUT of later frames within REACH
    for k in range(FAN_OUT):
        at = np.flatnonzero(later + k < len(t))
        to = later[at] + k
        near = t[to] - t[at] <= REACH
        at, to = at[near], to[near]
        times.append(t[at])
        hashes.append((f[at] << 16) | (f[to] << 8) | (t[to] - t[at]))
    times, hashes = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((hashes, times))
    return times[order].astype(np.int32), hashes[order].astype(np.int32)


def fingerprints(media: DataFrame, wav: str = "wav") -> DataFrame:
    """One row for each row of media: see SCHEMA. times and hashes are of one length and ordered by time, then hash.

    Null bytes give nulls and no error; bytes that aren't PCM WAV, the empty ones among them, give nulls and the
    reason in error; a file without samples gives empty arrays. A file of any length is transformed whole. Rows with
    null or repeated doc_id are treated like others; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frame.steps(batch, 1):
                rows = []
                for doc, data in zip(part.column(0).to_pylist(), part.column(1)):
                    if not data.is_valid:
                        rows.append((doc, None, None, None, None, None, None, None))
                        continue
                    try:
                        rate, channels, x = read_wav(data.as_py())
                        times, hashes = fingerprint(x)
                        rows.append((doc, rate, channels, len(x), len(x) / rate if rate else None, times, hashes, None))
                    except (wave.Error, EOFError, ValueError, struct.error) as e:
                        rows.append((doc, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                yield pa.record_batch([pa.array(list(c), kind) for c, kind in zip(zip(*rows), KINDS)], NAMES)

    return frame.plain(media, doc_id="long", **{wav: "binary"}).mapInArrow(run, SCHEMA)


KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def rendered(docs: DataFrame) -> DataFrame:
    """(doc_id, wav): each text as sound, its UTF-8 bytes being the samples of an 8-bit file at 8 kHz. Null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frame.steps(batch, 1):
                sound = [None if t is None else wav_bytes(np.frombuffer(t.encode(), np.uint8)) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(sound, pa.binary())], ["doc_id", "wav"])

    return frame.plain(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, wav binary")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents' sounds. The tables hold no audio, so each text's bytes are taken as samples."""
    return fingerprints(rendered(frame.read(spark, folder, "documents")))
