"""Operator 8, media columns: WAV files with spectral-peak pair fingerprints.

A payload of bytes is stored as an 8-bit mono WAV file in a binary column. Features come from the
stored file alone: the wave module reads it back, overlapping frames of 192 samples give a short-time Fourier
transform, the strongest local maxima of each frame are its peaks, and each peak is paired with
peaks of the next frames. A pair is one number (frequency, frequency, distance in time) and stands
with its time in two arrays of equal length.

Defined cases: a null or empty text is 576 bytes of padding. A flat spectrum has no peaks, so the
arrays are empty. Equal texts give equal values, repeated rows included. Very long texts are stored
whole and transformed BLOCK frames at a time. An empty table gives an empty result. Extra columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, read_documents, with_fields

UNIT = 576  #: what payloads are padded to
FRAME, HOP = 192, 96  #: samples of a frame, and from one frame to the next
RATE = 8000
PEAKS, AHEAD = 2, 1  #: peaks of a frame; frames that a peak is paired with
BLOCK = 2048  #: frames transformed at once: bounds memory on long payloads


def padded(text: str) -> bytes:
    payload = text.encode("utf-8", "surrogatepass")
    return payload + b"\xff" * (-len(payload) % UNIT if payload else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(payload: bytes) -> np.ndarray:
    """Frequency bins of each frame's strongest local maxima, the strongest first; 0 where there are fewer."""
    frames = np.lib.stride_tricks.sliding_window_view(np.frombuffer(payload, np.uint8), FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    out = np.zeros((len(frames), PEAKS), np.int64)
    for start in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft((frames[start : start + BLOCK].astype(np.float32) - 128) * window, axis=1))
        power = np.round(power, 1)  # so that equal sounds have equal peaks whatever the last bits
        inner = power[:, 1:-1]
        strength = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1), inner, 0)
        for k in range(PEAKS):
            best = strength.argmax(axis=1)
            rows = np.arange(len(best))
            out[start : start + BLOCK, k] = np.where(strength[rows, best] > 0, best + 1, 0)
            strength[rows, best] = 0
    return out


def pairs(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of peak pairs, by time, then code."""
    times, codes = [], []
    for ahead in range(1, AHEAD + 1):
        a, b = np.broadcast_arrays(bins[:-ahead, :, None], bins[ahead:, None, :])
        at = np.broadcast_to(np.arange(len(a))[:, None, None], a.shape)
        ok = (a > 0) & (b > 0)
        times.append(at[ok])
        codes.append((a[ok] << 20) | (b[ok] << 8) | ahead)
    t, c = np.concatenate(times).astype(np.int64), np.concatenate(codes).astype(np.int64)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def store(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns and media binary: each text as a WAV file."""
    return map_texts(docs, lambda texts: [pa.array([to_wav(padded(t)) for t in texts], pa.binary())], "media binary", keep)


ANALYSIS = "payload_bytes long, payload_sha256 string, tail binary, times array<int>, codes array<int>"


def analyze(stored: DataFrame) -> DataFrame:
    """stored with what its column media says when read back: payload facts and the time-coded fingerprint arrays."""
    schema = with_fields(stored, stored.columns, ANALYSIS)
    names = [x.split(" ")[0] for x in ANALYSIS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, rows = batch.slice(start, 256), []
                for media in part.column("media"):
                    payload = from_wav(media.as_py())
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), payload[-32:], *pairs(peaks(payload))))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*part.schema.names, *names])

    return stored.mapInArrow(run, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    print_of = F.sha2(F.concat_ws("|", F.array_join(F.col("times").cast("array<string>"), ","), F.array_join(F.col("codes").cast("array<string>"), ",")), 256)
    return analyze(store(docs, ["doc_id", "n_bytes"])).select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        F.crc32("tail").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("codes").cast("string"), print_of).alias("feature"),
    )
