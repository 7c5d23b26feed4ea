"""Media columns: texts as 8-bit WAV files, read by the wave module, with spectral-peak fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import common

UNIT = 64
RATE = 8000
FRAME = 256
HOP = 128
#: Each frame gives the strongest bin of each band, and each peak is paired with those of the next frames.
BANDS = ((1, 12), (12, 36), (36, 84), (84, 129))
FAN = 3
#: Bytes of results that a task holds before it hands them on, about.
HELD = 16_000_000
#: Frames transformed at once, which bounds memory whatever a file's length.
BLOCK = 4096


def payload(text: str | None) -> bytes:
    """The text's UTF-8 bytes, then bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is asked for")
        return r.readframes(r.getnframes()), r.getframerate()


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame number and bin of the strongest bin of each band, from a short-time Fourier transform.

    Frames that reach past the end are filled with the middle value 128; a frame's mean is taken away first, and a band whose
    magnitudes are all next to nothing, as in silence, has no peak. Equal magnitudes go to the lower bin.
    """
    raw = np.frombuffer(samples, np.uint8)
    frames = -(-len(raw) // HOP)
    window, times, bins = np.hanning(FRAME).astype(np.float32), [], []
    for at in range(0, frames, BLOCK):
        n = min(frames - at, BLOCK)
        part = raw[at * HOP : (at + n - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (n - 1) * HOP + FRAME - len(part)))
        part = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        part = (part - part.mean(axis=1, keepdims=True)) * window
        size = np.abs(np.fft.rfft(part, axis=1))
        for low, high in BANDS:
            best = size[:, low:high].argmax(axis=1)
            found = np.flatnonzero(size[np.arange(len(size)), low + best] > 1e-3)
            times.append(at + found)
            bins.append(low + best[found])
    times, bins = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (times, bins))
    order = np.lexsort((bins, times))
    return times[order], bins[order]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and codes: each peak with the peaks of the next FAN frames, as (bin, other bin, frames between)."""
    times, bins = peaks(samples)
    at, codes = [], []
    for step in range(1, FAN * len(BANDS) + len(BANDS)):
        gap = times[step:] - times[:-step]
        pair = np.flatnonzero((gap >= 1) & (gap <= FAN))
        at.append(times[pair])
        codes.append((bins[pair] << 16) | (bins[pair + step] << 8) | gap[pair])
    at, codes = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, codes))
    order = np.lexsort((codes, at))
    return at[order], codes[order]


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, media binary, fingerprint_times array<int>, fingerprint_codes array<int>, feature string"
)

STORED = ("media", "fingerprint_times", "fingerprint_codes")


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Stores each text of ``docs`` (doc_id, text) as a WAV file, reads it back and fingerprints what was read.

    ``feature`` sums up the fingerprint: frames, pairs and the checksum of times and codes. Without ``keep_media``
    the file and the two arrays are null. A row is worked on by itself, so no key and no copy is a hot spot.

    Defined results: a null or empty text is 64 bytes 0; repeated rows give equal rows; a text of any length is
    transformed block by block; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                media = write_wav(payload(text))
                samples, _ = read_wav(media)
                at, codes = fingerprint(samples)
                sums = zlib.crc32(np.stack([at, codes]).astype("<i4").tobytes())
                arrays = (media, at.astype(np.int32), codes.astype(np.int32)) if keep_media else (None, None, None)
                out.append((doc, len(text.encode("utf-8", "surrogatepass")), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), *arrays, f"{-(-len(samples) // HOP)}:{len(codes)}:{sums:08x}"))
                held += 200 + (len(media) + 8 * len(codes)) * keep_media
                if held > HELD:
                    yield rows(out)
                    out, held = [], 0
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.task("none", run), SCHEMA)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, then what they are of: the stored file and its time-coded fingerprint."""
    found = media_columns(common.table(spark, sf_dir, "documents"))
    return found.select(*(c for c in found.columns if c not in STORED), *STORED)
