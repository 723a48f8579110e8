"""Repeated passages against looking at every window."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import passages


def plain(rows):
    """doc_id, n_words, n_removed, kept of (doc_id, text), in the order of documents."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - passages.WINDOW + 1):
            window = tuple(words[p : p + passages.WINDOW])
            if window in seen:
                gone[p : p + passages.WINDOW] = [True] * passages.WINDOW
            seen.add(window)
        out.append((doc_id, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def result(docs, **kw):
    return sorted((tuple(r) for r in passages.without_repeats(docs, **kw).collect()), key=repr)


def made(n, seed, hot=0):
    """Texts of few words with passages of 15 to 60 words that many share, at any place; and groups of copies."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = [[rnd.choice(vocabulary) for _ in range(rnd.randint(15, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 3)):
            p, at = rnd.choice(shared), rnd.randint(0, len(words))
            cut = rnd.randint(0, 5)
            words[at:at] = p[cut:]
        if rnd.random() < 0.1:
            words += words
        rows.append((i, (" " if i % 2 else "\n ").join(words)))
    return rows + [(n + i, rows[3][1] + " tail") for i in range(hot)]


def test_the_cover_shows_every_match():
    """Whatever two places are, some offset below the period makes both cover positions."""
    cover = set(passages.COVER)
    for a in range(passages.PERIOD):
        for b in range(passages.PERIOD):
            assert any((a + i) % passages.PERIOD in cover and (b + i) % passages.PERIOD in cover for i in range(passages.PERIOD))
    assert passages.ANCHOR + passages.PERIOD - 1 == passages.WINDOW


@pytest.mark.parametrize("chunk,held", [(passages.CHUNK, passages.HELD), (2000, 50)])
def test_equals_every_window(spark, monkeypatch, chunk, held):
    """The second time with chunks of some documents and buckets of some hashes."""
    monkeypatch.setattr(passages, "CHUNK", chunk)
    monkeypatch.setattr(passages, "PART", min(passages.PART, chunk // 2))
    monkeypatch.setattr(passages, "HELD", held)
    rows = made(200, 3, hot=100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand(1)).repartition(5)
    got = result(docs)
    assert got == plain(rows) and sum(r[2] for r in got) > 5000


def test_anchors_find_all_windows_that_repeat():
    rows = made(60, 9)
    words = [t.split() for _, t in rows]
    chunk = passages.Chunk.of([i for i, _ in rows], [passages.pa.array([t for _, t in rows])])
    assert [len(w) for w in words] == chunk.sizes.tolist()
    again = passages.Chunk.unpacked(chunk.packed())
    assert [again.words[c].decode() for c in again.codes] == [x for w in words for x in w]
    at, hashes = chunk.anchors()
    _, back, n = np.unique(hashes, return_inverse=True, return_counts=True)
    windows = set(chunk.windows(at[n[back] > 1])[0].tolist())
    seen, base = {}, 0
    for w in words:
        for p in range(len(w) - 19):
            seen.setdefault(tuple(w[p : p + 20]), []).append(base + p)
        base += len(w)
    repeated = {p for places in seen.values() if len(places) > 1 for p in places}
    assert repeated and repeated <= windows and len(windows) < 4 * len(repeated)


def test_awkward_rows(awkward, clashing, empty):
    got = result(awkward)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["x"])
    order = sorted(awkward.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("x")).collect(), key=key)
    assert got == plain([(r["doc_id"], r["text"]) for r in order])
    assert result(clashing) == got and result(empty) == []
    twice = awkward.union(awkward.where("doc_id = 6"))
    assert [r[:3] for r in result(twice) if r[0] == 6] == [(6, 30000, 29999), (6, 30000, 30000)]


def test_query_digests(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])
    got = sorted((tuple(r) for r in passages.query(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in want]
