import zlib

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import near_dedup, pieces, quality
from foliant.llm.common import only


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_scores(spark, tables):
    docs, labels = tables
    weights = quality.fit(docs, labels)
    assert (weights == quality.fit(docs, labels)).all()
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = {r["doc_id"]: r for r in quality.scored(docs, weights).collect()}
    assert len(rows) == docs.count()
    for r in docs.collect():
        got = rows[r["doc_id"]]
        at, x = quality.features(r["text"])
        assert got["score"] == pytest.approx(quality.logistic(float(weights[at] @ x) + float(weights[-1])), abs=1e-5)
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and got["predicted"] == int(got["score"] >= 0.3)
    held = [r for r in rows.values() if r["held_out"] and r["doc_id"] in known]
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.9


def test_labels_of_held_out_rows_are_not_learnt(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert (quality.fit(docs, labels) == quality.fit(docs, turned)).all()


def test_awkward_rows(spark, awkward, empty, tables):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0), (8, 1), (9, 1), (10, 0), (99, 1)], "doc_id long, quality int")
    weights = quality.fit(awkward, labels)
    rows = quality.scored(awkward, weights).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {None}
    kept = quality.keep_good(awkward, labels)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == sorted((r["doc_id"] or -1) for r in rows if r["predicted"])
    none = quality.fit(awkward, labels.where("false"))
    assert {r["score"] for r in quality.scored(awkward, none).collect()} == {0.5}
    assert quality.scored(empty, weights).count() == 0 and quality.keep_good(empty, labels).count() == 0


def test_sample_is_bounded(spark, tables):
    docs, labels = tables
    assert (quality.fit(docs, labels, sample=5) != quality.fit(docs, labels)).any()


def test_shapes():
    assert [quality.shape(w.encode()) for w in ("word", "Word,", "WORD!!", "a", "A", "x9***", "|", "éÉ")] == [b"a", b"T,", b"A!!", b"a", b"T", b"a9***", b"-|", b"x"]


def plain_features(text):
    """n-grams one by one, hashed with whole numbers."""
    import re

    import xxhash

    full = (1 << 64) - 1
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    h = [xxhash.xxh64_intdigest(w) for w in words]
    form = [int(quality.SAME) if i and words[i] == words[i - 1] else xxhash.xxh64_intdigest(quality.shape(w), seed=7) for i, w in enumerate(words)]
    a, b, c, d = map(int, quality.SEEDS)
    raw = [x * a & full for x in h] + [x * b & full for x in form]
    raw += [((x * c & full) ^ y) * d & full for x, y in zip(h, h[1:])] + [((x * d & full) ^ y) * c & full for x, y in zip(form, form[1:])]
    out = {}
    for x in raw:
        x = (x ^ x >> 29) * int(quality.MIX) & full
        out[x >> 64 - quality.BITS] = out.get(x >> 64 - quality.BITS, 0) + 1
    return {k: n * quality.SCALE / max(1, len(words)) for k, n in out.items()}


def test_features_and_scores_against_plain_ones(spark, tables):
    rng = np.random.default_rng(4)
    texts = [r["text"] or "" for r in tables[0].collect()][:60] + ["", " ", "x", "x x x", "a\u00a0b c", "naïve 日本 日本", "w " * 30_000]
    weights = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    got = quality.scores(texts, weights)
    for t, score in zip(texts, got):
        want = plain_features(t)
        at, x = quality.features(t)
        assert at.tolist() == sorted(want) and x.tolist() == pytest.approx([want[k] for k in at.tolist()])
        z = sum(v * float(weights[k]) for k, v in want.items()) + float(weights[-1])
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    assert quality.scores(texts[:1], weights)[0] == pytest.approx(got[0])


def test_ftrl_against_a_plain_one():
    rng = np.random.default_rng(6)
    size, alpha, beta, l1, l2 = 64, 0.5, 1.0, 0.05, 0.5
    model, z, n = quality.FTRL(size, alpha, beta, l1, l2), {}, {}
    for _ in range(300):
        at = np.sort(rng.choice(size, rng.integers(0, 9), replace=False)).astype(np.int32)
        x, y = rng.random(len(at)).astype(np.float32), int(rng.random() < 0.4)
        model.learn(at, x, y)
        pairs = [*zip(at.tolist(), x.tolist()), (size, 1.0)]
        w = {}
        for k, _ in pairs:
            zk, nk = z.get(k, 0.0), n.get(k, 0.0)
            w[k] = 0.0 if abs(zk) <= l1 else -(zk - np.sign(zk) * l1) / ((beta + nk**0.5) / alpha + l2)
        p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in pairs)))
        for k, v in pairs:
            g = (p - y) * v
            z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / alpha * w[k]
            n[k] = n.get(k, 0.0) + g * g
    want = [0.0 if abs(z.get(k, 0.0)) <= l1 else -(z[k] - np.sign(z[k]) * l1) / ((beta + n[k] ** 0.5) / alpha + l2) for k in range(size + 1)]
    assert model.dense().tolist() == pytest.approx(want, abs=1e-4)


def test_what_reaches_the_driver_is_bounded(spark, monkeypatch):
    """By rows and bytes: of a long text, all features are learnt, or the row isn't."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50 + 5000 * (i == 7)))) for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    learnt = []
    monkeypatch.setattr(quality.FTRL, "learn", lambda self, at, x, y: learnt.append((tuple(at.tolist()), float(x.sum()), y)))
    quality.fit(docs, labels)
    want = {(tuple(at.tolist()), float(x.sum()), r["doc_id"] % 2) for r in docs.where(~quality.held_out()).collect() for at, x in [quality.features(r["text"])]}
    assert set(learnt) == want and len(learnt) == quality.EPOCHS * len(want)
    learnt.clear()
    quality.fit(docs, labels, held=10_000)
    assert set(learnt) < want and 8 * sum(len(at) for at, *_ in set(learnt)) <= 10_000 and len(learnt) > 0
    learnt.clear()
    quality.fit(docs, labels, sample=5)
    assert len(set(learnt)) == 5


def in_workers(spark, look):
    """What look() gives in the Python workers."""

    def run(batches):
        list(batches)
        yield pa.record_batch([pa.array([look()])], names=["got"])

    return [r["got"] for r in spark.range(0, 4, 1, 4).mapInArrow(run, "got long").collect()]


@pytest.fixture
def fresh(spark):
    """Python workers that have run nothing yet."""
    env = spark.sparkContext.environment
    env["FOLIANT_TEST_WORKERS"] = str(id(env))
    yield spark
    del env["FOLIANT_TEST_WORKERS"]


def test_scoring_leaves_no_second_cache(fresh, tables):
    docs, _ = tables
    quality.scored(docs, np.zeros((1 << quality.BITS) + 1, np.float32)).collect()
    assert any(in_workers(fresh, lambda: len(quality.KNOWN)))

    def left():
        only(near_dedup.KNOWN)
        return len(quality.KNOWN)

    assert not any(in_workers(fresh, left))


def test_memory_of_workers(fresh, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda *_: np.zeros((1 << quality.BITS) + 1, np.float32))
    path = f"file://{tmp_path}/docs"
    fresh.range(0, 8000, 1, 1).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 300), i -> substr(md5(concat(id, '-', i)), 1, 7))) as text").write.parquet(path)
    docs = fresh.read.parquet(path).coalesce(1)

    def most():
        with open("/proc/self/status") as f:
            return next(int(line.split()[1]) >> 10 for line in f if line.startswith("VmHWM"))

    before = min(in_workers(fresh, most))
    assert quality.keep_good(docs.repartition(1), None).count() == 8000
    after = max(in_workers(fresh, most))
    pieces.encoded(docs.repartition(1)).collect()
    last = max(in_workers(fresh, most))
    assert after - before < 120 and last - before < 300  # MB; a scored batch and what both stages keep
