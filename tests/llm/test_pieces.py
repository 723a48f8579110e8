import hashlib
import random

import public_tokenizers
import pytest

from foliant.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(public_tokenizers.path(pieces.MODEL))


def ids(model, texts):
    return [got for got, _ in model.encode(texts)]


def library(model, texts):
    return [model.sp.encode(t) + [model.end] for t in texts]


def test_every_piece_and_pairs(model):
    rng = random.Random(1)
    texts = [p.replace("▁", " ") for p in model.text.values()]
    texts += [rng.choice(texts) + rng.choice(texts) for _ in range(5000)]
    assert ids(model, texts) == library(model, texts)


def test_fuzz(model):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aebct hin  ▁\n\té日本🙂\0''  12.=-—ing the") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    assert ids(model, texts) == library(model, texts)


def test_long_words_and_runs(model):
    texts = ["", " ", "a" * 3000, "ab" * 1500 + " " * 3000 + "x", " " * 999, "thing" * 600, "=-" * 500, "日本" * 600]
    assert ids(model, texts) == library(model, texts)


def test_very_long_words_take_seconds(model):
    import time

    rng = random.Random(7)
    texts = ["a" * 300_000, "".join(rng.choice("etaoinshrdlu") for _ in range(300_000)), "".join(rng.choice("日本語é🙂x") for _ in range(100_000)), "=-" * 100_000]
    began = time.perf_counter()
    got = ids(model, texts)
    assert time.perf_counter() - began < 30
    assert got == library(model, texts)


def test_long_words_fuzzed(model):
    rng = random.Random(9)
    pool = [p.strip("▁") for p in list(model.text.values())[::37]] + list("abcdefghij,.-é日")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(20, 60))) for _ in range(1500)]
    assert ids(model, texts) == library(model, texts)


def test_cache_is_bounded(model):
    old, model.LIMIT = model.LIMIT, 50
    try:
        texts = [f"word{i} and{i % 7}" for i in range(200)]
        assert ids(model, texts) == library(model, texts)
        assert ids(model, texts[:20]) == library(model, texts[:20]) and len(model.known) <= 50
    finally:
        model.LIMIT = old


def test_query(spark, sf, awkward, empty, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for table in (docs, awkward):
        want = []
        for r in table.collect():
            i = model.sp.encode(r["text"] or "") + [model.end]
            want.append((r["doc_id"], len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(model.sp.decode(i).encode()).hexdigest()))
        assert sorted(map(tuple, pieces.encoded(table).collect()), key=repr) == sorted(want, key=repr)
    assert pieces.encoded(empty).count() == 0
    assert [r["ids"] for r in pieces.token_ids(awkward.where("doc_id = 8")).collect()] == library(model, ["x"])
