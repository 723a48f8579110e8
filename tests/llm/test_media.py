import hashlib
import io
import wave
import zlib

import numpy as np

from foliant.llm import media


def test_query(spark, sf, awkward, empty, tmp_path):
    seen_paths = []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for table in (docs, awkward):
        seen = {}
        kept = media.stored(media.to_media(table), f"file://{tmp_path}/{len(seen_paths)}")
        seen_paths.append(kept)
        for r in spark.read.parquet(f"file://{tmp_path}/{len(seen_paths) - 1}/media").collect():  # a WAV file each
            with wave.open(io.BytesIO(r["media"])) as f:
                assert f.getsampwidth() == f.getnchannels() == 1 and f.getnframes() % 64 == 0
        got = media.fingerprints(kept).collect()
        want = []
        for r in table.collect():
            data = (r["text"] or "").encode()
            full = data + b"\0" * (64 if not data else -len(data) % 64)
            want.append((r["doc_id"], len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
        for r in got:
            assert seen.setdefault(r["payload_sha256"], (r["feature"], r["media_sha256"], r["peak_codes"])) == (r["feature"], r["media_sha256"], r["peak_codes"])
            assert len(r["peak_times"]) == len(r["peak_codes"]) and r["peak_times"] == sorted(r["peak_times"])
            assert r["media_bytes"] == r["payload_bytes"] + 44
    assert media.fingerprints(media.stored(media.to_media(empty))).count() == 0


def test_round_trip():
    for payload in (bytes(64), bytes(range(256)) * 3):
        assert media.from_wav(media.to_wav(payload)) == payload


def test_blocks_dont_matter(monkeypatch):
    x = np.random.default_rng(1).integers(0, 256, 50_000).astype(np.uint8).tobytes()
    whole = media.fingerprint(x)[2]
    monkeypatch.setattr(media, "BLOCK", 7)
    assert media.fingerprint(x)[2] == whole


def test_a_tone_is_found():
    t = np.arange(8000)
    samples = (128 + 100 * np.sin(2 * np.pi * 1000 * t / 8000)).astype(np.uint8)
    frames, bins, n = media.peaks(samples)
    assert n == 1 + (8000 - 256) // 128 and 32 in bins  # 1000 Hz of 8000 over 256 bins


def test_a_part_matches_in_time():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, 128 * 400).astype(np.uint8)
    t1, c1, _ = media.fingerprint(x.tobytes())
    t2, c2, _ = media.fingerprint(x[128 * 100 : 128 * 300].tobytes())
    at = {c: t for t, c in zip(t1.tolist(), c1.tolist())}
    shifts = [at[c] - t for t, c in zip(t2.tolist(), c2.tolist()) if c in at]
    assert np.bincount([s for s in shifts if s >= 0]).argmax() == 100


def test_peaks_are_paired_with_those_that_follow():
    rng = np.random.default_rng(5)
    short = 0
    for size in [64, 128, 256, 384, 448, 640, 1472, *range(2048, 20_000, 2048)] * 10:
        frames, bins, n = media.peaks(rng.integers(32, 127, size).astype(np.uint8))
        want = []
        every, one = list(zip(frames.tolist(), bins.tolist())), len(set(frames.tolist())) == 1
        for i, (a, x) in enumerate(every):
            later = [(b, y) for j, (b, y) in enumerate(every) if b > a or (one and j > i)][: media.FAN]
            want += [(a, x << 14 | y << 6 | b - a) for b, y in later if b - a <= media.ZONE]
        times, codes = media.pairs(frames, bins)
        assert list(zip(times.tolist(), codes.tolist())) == sorted(want)
        assert want
        short += one
    assert short
    far = np.array([0, 63, 64, 127, 128], np.int32)
    assert media.pairs(far, far)[0].tolist() == [0, 63, 64, 127]
    none = np.empty(0, np.int32)
    assert [x.tolist() for x in media.pairs(none, none)] == [[], []]


def test_the_end_counts():
    rng = np.random.default_rng(7)
    for size in (64, 192, 256, 320, 384, 448, 704, 1472):
        x = rng.integers(32, 127, size).astype(np.uint8)
        y = x.copy()
        y[-64:] = rng.integers(32, 127, 64)
        assert media.fingerprint(x.tobytes())[2].split(":")[1] == str(1 + max(0, -(-(size - 256) // 128)))
        if size >= 256:
            assert media.fingerprint(x.tobytes())[2] != media.fingerprint(y.tobytes())[2]


def test_short_texts_have_fingerprints_of_their_own():
    rng = np.random.default_rng(9)
    texts = {rng.integers(97, 123, size).astype(np.uint8).tobytes() for size in range(20, 250) for _ in range(3)}
    found = {media.fingerprint(media.padded(t))[2] for t in texts}
    assert len(found) > 0.95 * len(texts) and not any(f.split(":")[3] == "0" for f in found)


def plain_peaks(samples):
    """Peaks by the definition of the transform, a frame and a bin at a time."""
    n = max(1, 1 + (len(samples) - media.FRAME) // media.HOP)
    x = np.concatenate([samples.astype(float), np.full(max(0, media.FRAME - len(samples)), 128.0)]) - 128
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)]
    turn = [np.exp(-2j * np.pi * k * np.arange(media.FRAME) / media.FRAME) for k in range(media.FRAME // 2 + 1)]
    best = []
    for f in range(n):
        frame = x[f * media.HOP : f * media.HOP + media.FRAME] * window
        energy = [abs((frame * turn[k]).sum()) ** 2 for k in range(media.FRAME // 2 + 1)]
        best.append([max((energy[k], -k) for k in range(lo, hi)) for lo, hi in media.BANDS])
    out = []
    for f in range(n):
        for b in range(len(media.BANDS)):
            near = [best[g][b][0] for g in range(max(0, f - media.REACH), min(n, f + media.REACH + 1))]
            if best[f][b][0] >= max(near) and best[f][b][0] > 1e-3:
                out.append((f, -best[f][b][1]))
    return out


def test_peaks_equal_a_plain_transform():
    rng = np.random.default_rng(2)
    for size in (64, 256, 512, 2048, 5120):
        samples = rng.integers(32, 127, size).astype(np.uint8)
        frames, bins, _ = media.peaks(samples)
        assert list(zip(frames.tolist(), bins.tolist())) == plain_peaks(samples)
