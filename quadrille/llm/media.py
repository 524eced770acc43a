"""Media columns: PCM audio in WAV form and its spectral-peak fingerprint."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import bounded_batches

__all__ = ["padded", "to_wav", "from_wav", "peak_pairs", "with_media"]

RATE = 8000
FRAME = 512
HOP = 64
PEAKS = 3
FAN = 3
AHEAD = 8
BAND = 32
BLOCK = 2048


def padded(raw: bytes, unit: int = 64) -> bytes:
    """``raw`` and zeros up to a positive multiple of ``unit``; nothing is added to one already."""
    return raw + b"\0" * (-len(raw) % unit if raw else unit)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    """The samples of an 8-bit mono WAV file."""
    with wave.open(io.BytesIO(data)) as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono only")
        return w.readframes(w.getnframes())


def peak_pairs(samples: bytes, frame: int = FRAME, hop: int = HOP, peaks: int = PEAKS, fan: int = FAN, ahead: int = AHEAD, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes of spectral-peak pairs (after Wang 2003).

    Short-time Fourier transform with a Hann window; the ``peaks`` strongest local maxima of a
    frame's power are its peaks (ties: the lower bin). Frames overlap. Each peak is paired with
    the first ``fan`` peaks, by frame and bin, of its target zone: 1 to ``ahead`` frames later and
    at most ``band`` bins higher or lower. A pair's hash is f1 << 20 | f2 << 8 | dt and its time the
    first peak's frame. The last frame is padded with silence. Blocks of frames bound the memory.
    """
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-max(len(x) - frame, 0) // hop) + 1)
    window = np.hanning(frame).astype(np.float32)
    times, bins = [], []
    for k in range(0, n, BLOCK):
        m = min(BLOCK, n - k)
        part = x[k * hop : (k + m - 1) * hop + frame].astype(np.float32) - 128
        part = np.concatenate((part, np.zeros((m - 1) * hop + frame - len(part), np.float32)))
        frames = np.lib.stride_tricks.sliding_window_view(part, frame)[::hop] * window
        power = np.abs(np.fft.rfft(frames, axis=1)[:, 1:]) ** 2
        power = np.round(np.log1p(power), 3)
        inner = power[:, 1:-1]
        high = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        top = np.argsort(-high, axis=1, kind="stable")[:, :peaks]
        ok = np.take_along_axis(high, top, 1) > 0
        t = np.repeat(np.arange(k, k + m), peaks).reshape(m, peaks)
        top = np.where(ok, top, 1 << 30)
        top.sort(axis=1)
        times.append(t[top < 1 << 30])
        bins.append(top[top < 1 << 30] + 2)
    t, f = np.concatenate(times), np.concatenate(bins)
    out_t, out_h = [], []
    found = np.zeros(len(t), np.int64)
    for j in range(1, min(len(t), peaks * (ahead + 1))):  # no peak of the zone is further in the list
        dt = t[j:] - t[:-j]
        i = np.flatnonzero((dt > 0) & (dt <= ahead) & (np.abs(f[j:] - f[:-j]) <= band) & (found[:-j] < fan))
        found[i] += 1
        out_t.append(t[i])
        out_h.append(f[i] << 20 | f[i + j] << 8 | dt[i])
    if not out_t:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    t, h = np.concatenate(out_t), np.concatenate(out_h)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32)


def with_media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each text's bytes as a WAV column, read back and fingerprinted.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, peak_times, peak_hashes`` and, if asked for, ``media`` itself. Null texts count
    as empty ones (64 bytes of zero). Equal texts give equal values. One pass, no shuffle.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, peak_times array<int>, peak_hashes array<int>" + ", media binary" * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(8 + keep_media)]
            for raw in b.column(1).to_pylist():
                media = to_wav(padded(raw))
                back = from_wav(media)
                t, h = peak_pairs(back)
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), t, h, media)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "peak_times", "peak_hashes", "media"][: 9 + keep_media])

    return docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw")).mapInArrow(run, schema)
