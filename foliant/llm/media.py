r"""Media columns: lossless WAV in a binary column, short-time Fourier transforms, spectral-peak pair fingerprints.

to_media() makes bytes mono 8-bit samples of a WAV file, one a row, in a binary column; stored() writes such a table to the shared
folder and reads it again, so that all that follows comes from stored bytes. fingerprints() reads the column with the wave module and transforms overlapping frames. In each frame the strongest bin of each band is a
peak if no frame within REACH has a stronger one in that band. Each peak is paired with the FAN peaks that
follow it within a target zone; peaks that all stand in one frame, as those of short texts do, are paired with each other. A pair's
code packs both frequencies and their distance, its time is the anchor's frame. Both are stored as arrays ordered by time, so that fingerprints are matched by code and aligned by time.
Samples of silence (128) are added until the last frame ends with the audio, so that every sample is in a frame.

Audio is transformed in blocks of frames, so beside a text itself memory grows by a few numbers a frame only.

Defined results: a null text counts as empty; a very long text is one file, up to the 2 GB that a value of a column may have; a payload is padded with bytes 0 to a positive multiple of 64, so
an empty text has 64 of them; repeated rows and equal texts give equal values; a null doc_id is passed on; an empty table
gives an empty result; other columns are never read.
"""

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

from .common import slices, spread, staged, table, text_of, workspace

RATE = 8000
UNIT = 64  # payloads are padded to multiples of it
FRAME, HOP = 256, 128
BANDS = ((2, 6), (6, 12), (12, 24), (24, 44), (44, 76), (76, 129))  # bins
REACH = 4  # frames around a peak in which it is the strongest
FAN, ZONE = 2, 63  # pairs a peak, and frames they span at most
BLOCK = 4096  # frames transformed at once
WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, RATE, len(payload), "NONE", ""))
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit file")
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Frames and bins of the peaks, by time and then bin, and the number of frames."""
    n = max(1, 1 + (len(samples) - FRAME) // HOP)
    if len(samples) < FRAME:
        samples = np.concatenate([samples, np.full(FRAME - len(samples), 128, np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    bins, power = np.empty((len(BANDS), n), np.int16), np.empty((len(BANDS), n), np.float32)
    for a in range(0, n, BLOCK):
        part = (views[a : a + BLOCK].astype(np.float32) - 128) * WINDOW
        spectrum = np.fft.rfft(part, axis=1)
        energy = spectrum.real**2 + spectrum.imag**2
        for k, (lo, hi) in enumerate(BANDS):
            best = energy[:, lo:hi].argmax(1)
            bins[k, a : a + BLOCK] = best + lo
            power[k, a : a + BLOCK] = energy[np.arange(len(best)), best + lo]
    held = np.pad(power, ((0, 0), (REACH, REACH)), constant_values=-1)
    top = np.lib.stride_tricks.sliding_window_view(held, 2 * REACH + 1, axis=1).max(2)
    frames, bands = np.nonzero(((power >= top) & (power > 1e-3)).T)
    return frames.astype(np.int32), bins[bands, frames].astype(np.int32), n


def pairs(frames: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the pairs: 8 bits of either bin and 6 of the distance in frames."""
    times, codes = [], []
    after = np.searchsorted(frames, frames, side="right")  # the first peak beyond those of its own frame
    if len(frames) and frames[0] == frames[-1]:  # there is no other frame
        after = np.arange(1, len(frames) + 1)
    for k in range(FAN):
        a = np.flatnonzero(after + k < len(frames))
        b = after[a] + k
        apart = frames[b] - frames[a]
        ok = apart <= ZONE
        times.append(frames[a][ok])
        codes.append((bins[a][ok] << 14) | (bins[b][ok] << 6) | apart[ok])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray, str]:
    """Times, codes, and a digest of both with the numbers of frames and peaks. Silence fills the last frame."""
    filled = np.frombuffer(samples + bytes([128]) * (-(len(samples) - FRAME) % HOP), np.uint8)
    frames, bins, n = peaks(filled)
    times, codes = pairs(frames, bins)
    digest = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
    return times, codes, f"stft{FRAME}/{HOP}:{n}:{len(frames)}:{len(times)}:{digest}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (a WAV file)."""
    return spread(docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def stored(media: DataFrame, path: str | None = None) -> DataFrame:
    """Write the media to a folder of the shared one and read them back."""
    return staged(media, f"{path or workspace(media.sparkSession, 'media')}/media")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media"):
        payloads, shas, tails, sizes, digests, features, times, codes = [], [], [], [], [], [], [], []
        for media in batch.column(2):
            media = media.as_buffer().to_pybytes()
            payload = from_wav(media)
            t, c, feature = fingerprint(payload)
            payloads.append(len(payload))
            shas.append(hashlib.sha256(payload).hexdigest())
            tails.append(zlib.crc32(payload[-UNIT:]))
            sizes.append(len(media))
            digests.append(hashlib.sha256(media).hexdigest())
            features.append(feature)
            times.append(t)
            codes.append(c)
        ends = pa.array(np.concatenate([[0], np.cumsum(list(map(len, times)))]), pa.int32())
        arrays = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int32())) for x in (times, codes)]
        columns = [pa.array(x, kind) for x, kind in ((payloads, pa.int64()), (shas, pa.string()), (tails, pa.int64()), (sizes, pa.int64()), (digests, pa.string()), (features, pa.string()))]
        yield pa.record_batch([batch.column(0), batch.column(1), *columns, *arrays], names=NAMES)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "peak_times", "peak_codes"]


def fingerprints(media: DataFrame) -> DataFrame:
    """From to_media()'s rows: what is read back from the stored files, and their fingerprints."""
    return media.mapInArrow(
        _read,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, peak_times array<int>, peak_codes array<int>",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(stored(to_media(table(spark, sf_dir, "documents"))))
