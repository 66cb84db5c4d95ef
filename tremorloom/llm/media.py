"""Media columns: texts kept as WAV samples, with spectral-peak pair fingerprints.

Each text becomes a payload of whole 64-byte blocks, is stored as 8-bit mono samples in a WAV container, read back with
the wave module, and described by a constellation: the strongest bins of each short-time Fourier frame, paired with
peaks of the following frames and kept as arrays coded by time. Nothing crosses rows, so no shuffle is needed.

Frames overlap, and silence before and after lets every byte be met by frames at different places of the window, so any text has
several frames. Texts of one or two words may still share their few peaks. Null and empty texts, and texts of zero bytes alone,
are silence and give a fingerprint without pairs, the first two over one zero block; equal texts give equal values; repeated rows
stay repeated; columns besides those named are left out of the result of media_digest and kept by with_media.
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
from pyspark.sql import functions as F

BLOCK = 64
RATE = 8000
FRAME = 128
HOP = 32
PEAKS = 2
FAN_OUT = 2
#: Frames that one Fourier step takes; whole signals are covered step by step.
STEP_FRAMES = 4096

_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of the block, and the length before padding."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK), len(raw)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Rows (frames) of the strongest bins, ascending; samples are centred, and zeros at the end count as silence."""
    x = np.frombuffer(samples, np.uint8)
    heard = np.flatnonzero(x)
    if not len(heard):
        return np.zeros((0, PEAKS), np.int64)
    heard = x[: heard[-1] + 1]
    around = FRAME - HOP
    frames = -(-(len(x) + 2 * around - FRAME) // HOP) + 1
    x = np.zeros(FRAME + (frames - 1) * HOP, np.float32)
    x[around : around + len(heard)] = heard - np.float32(heard.mean())
    out = []
    for at in range(0, frames, STEP_FRAMES):
        to = min(at + STEP_FRAMES, frames)
        part = x[at * HOP : (to - 1) * HOP + FRAME]
        view = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        level = np.abs(np.fft.rfft(view * _WINDOW, axis=1))[:, 1:].astype(np.float32)
        best = np.argpartition(level, -PEAKS, axis=1)[:, -PEAKS:]
        out.append(np.sort(best, axis=1) + 1)
    return np.concatenate(out)


def pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pair codes and their anchor frames: anchor bin, target bin and frame distance packed as one integer."""
    found = peaks(samples)
    codes, times = [], []
    for gap in range(1, FAN_OUT + 1):
        if len(found) > gap:
            a, b = found[:-gap, :, None], found[gap:, None, :]
            codes.append(((a * 1024 + b) * 16 + gap).reshape(len(found) - gap, -1))
            times.append(np.repeat(np.arange(len(found) - gap), PEAKS * PEAKS).reshape(codes[-1].shape))
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    code, time = np.concatenate([x.ravel() for x in codes]), np.concatenate([x.ravel() for x in times])
    order = np.lexsort((code, time))
    return code[order].astype(np.int32), time[order].astype(np.int32)


STEP_ROWS = 256
_MEDIA = pa.schema([("media", pa.binary()), ("n_bytes", pa.int64()), ("pair_codes", pa.list_(pa.int32())), ("pair_times", pa.list_(pa.int32()))])
_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def _media(texts: list[str | None]) -> list[pa.Array]:
    """The columns of _MEDIA for some texts; features come from the bytes read back out of the container."""
    rows = []
    for x in texts:
        raw, n = payload(x)
        stored = to_wav(raw)
        rows.append((stored, n, *pairs(from_wav(stored))))
    return [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _MEDIA, strict=True)]


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """df with media (WAV bytes), n_bytes, pair_codes and pair_times (arrays of equal length); columns so named are replaced."""
    schema = df.withColumns({"media": F.lit(b""), "n_bytes": F.lit(0).cast("long"), "pair_codes": F.array(F.lit(0)), "pair_times": F.array(F.lit(0))}).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                new = dict(zip(_MEDIA.names, _media(part.column(text).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([new[n] if n in new else part.column(n) for n in schema.names], schema.names)

    return df.mapInArrow(add, schema)


def media_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, lengths and hashes of the stored form and of the payload read back from it, and the fingerprint's digest."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                stored, sizes, codes, times = _media(part.column(text).to_pylist())
                rows = []
                for media, n, code, time in zip(stored, sizes, codes, times, strict=True):
                    media = media.as_py()
                    back = from_wav(media)
                    coded = np.asarray(time.values, "<i4").tobytes() + np.asarray(code.values, "<i4").tobytes()
                    rows.append((n.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(code.values)}:{hashlib.sha256(coded).hexdigest()}"))
                columns = [part.column("doc_id").cast(pa.int64()), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(_DIGEST)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=_DIGEST)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select("doc_id", F.col(text)).mapInArrow(digest, schema)
