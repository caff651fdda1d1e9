"""Media columns: texts kept as 8-bit WAV files, short-time Fourier transforms and spectral-peak pair fingerprints.

Defined results: a null text counts as empty; the empty payload is padded to one full unit of 192 bytes; equal
payloads give equal WAV bytes and equal fingerprints, whatever batch they travel in (every transform runs on one
file alone, in fixed runs of frames, so memory stays bounded for very long files).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from graphloom.llm.text import map_texts

RATE, WINDOW, HOP, UNIT, PAD = 8000, 256, 128, 192, b"\x20"
#: Frequency bins of each band that gives one peak a frame, and the distances in frames at which peaks are paired.
BANDS, STEPS = ((2, 16), (16, 48), (48, 128)), (1, 2, 4)
#: Frames that are transformed at once.
RUN = 4096
_HANN = np.hanning(WINDOW).astype(np.float32)


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + PAD * (UNIT - len(raw) if not raw else -len(raw) % UNIT), len(raw)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Magnitudes of ``count`` windowed frames from frame ``first``; the last frame is filled with silence."""
    part = samples[first * HOP : (first + count - 1) * HOP + WINDOW]
    part = np.pad(part, (0, (count - 1) * HOP + WINDOW - len(part)))
    return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, WINDOW)[::HOP] * _HANN, axis=1))


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bin of every band in every frame, 0 where the band is silent."""
    frames = max(1, -(-max(0, len(samples) - WINDOW) // HOP) + 1)
    found = np.zeros((frames, len(BANDS)), np.int64)
    for first in range(0, frames, RUN):
        power = spectrum(samples, first, min(RUN, frames - first))
        for b, (low, high) in enumerate(BANDS):
            best = power[:, low:high].argmax(1)
            loud = power[np.arange(len(best)), best + low] > 1e-3
            found[first : first + len(best), b] = np.where(loud, best + low, 0)
    return found


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pair hashes and their time codes: (bin, later bin, distance) of peaks, by time, band and distance."""
    p = peaks((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
    hashes, times = [], []
    for step in STEPS:
        if len(p) > step:
            early, late = p[:-step], p[step:]
            for b in range(len(BANDS)):
                h = (early[:, b] << 16) | (late[:, (b + 1) % len(BANDS)] << 8) | step
                keep = (early[:, b] > 0) & (late[:, (b + 1) % len(BANDS)] > 0)
                hashes.append(h[keep])
                times.append(np.nonzero(keep)[0])
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, t = np.concatenate(hashes), np.concatenate(times)
    order = np.lexsort((h, t))
    return h[order], t[order]


def media_rows(ids: list, texts: list[str], arrays: bool) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "fingerprint")}
    for doc, text in zip(ids, texts, strict=True):
        payload, n = payload_of(text)
        media = to_wav(payload)
        back = from_wav(media)
        h, t = fingerprint(back)
        out["doc_id"].append(doc)
        out["n_bytes"].append(n)
        out["payload_bytes"].append(len(back))
        out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
        out["tail_crc32"].append(zlib.crc32(back[-16:]))
        out["media_bytes"].append(len(media))
        out["media_sha256"].append(hashlib.sha256(media).hexdigest())
        out["feature"].append(hashlib.sha256(np.stack([h, t]).astype("<i8").tobytes()).hexdigest())
        if arrays:
            out["media"].append(media)
            out["fingerprint"].append([{"hash": a, "t": b} for a, b in zip(h.tolist(), t.tolist(), strict=True)])
    return out


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame) -> DataFrame:
    """Digests beside the stored WAV file and its time-coded fingerprint array (``t`` counts hops of 128 samples)."""
    return map_texts(docs, lambda i, t: media_rows(i, t, True), DIGESTS + ", media binary, fingerprint array<struct<hash:bigint,t:bigint>>")


def media_digests(docs: DataFrame) -> DataFrame:
    """The same files and fingerprints, of which only digests leave the workers."""
    return map_texts(docs, lambda i, t: media_rows(i, t, False), DIGESTS)
