import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import rans, token_files
from foliant.llm.common import read_file, workspace


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 511, 512, 513, 100_000, 300_000):
        tokens = np.minimum(rng.geometric(0.01, n), 49_000)
        coder = rans.Coder.of(tokens)
        assert coder.f.sum() == rans.TOTAL
        data = rans.pack_block(coder, tokens, [7, None], [n - 1, 1])
        ids, lengths, got = rans.unpack_block(coder, data)
        assert ids == [7, None] and lengths.tolist() == [n - 1, 1] and (got == tokens).all()
        parts = -(-n // (rans.LANES * rans.CHECK))
        assert (np.concatenate([rans.unpack_block(coder, data, p)[2] for p in range(parts)]) == tokens).all()


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(2)
    tokens = rng.zipf(1.3, 400_000) % 5000
    counts = np.bincount(tokens)
    p = counts[counts > 0] / len(tokens)
    assert len(rans.pack_file([(1, tokens)])) < 1.1 * len(tokens) * -(p * np.log2(p)).sum() / 8 + 20_000


def test_damage_is_found():
    data = bytearray(rans.pack_file([(1, np.arange(1000))]))
    data[-10] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(rans.unpack_file(bytes(data)))
    assert list(rans.unpack_file(rans.pack_file([]))) == []


def brute(rows):
    t = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf, awkward, empty, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for table in (docs, awkward):
        got = token_files.read_tokens(token_files.write_tokens(table, workspace(spark, "test"))).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == brute([(r["doc_id"], r["text"]) for r in table.collect()])
    assert token_files.read_tokens(token_files.write_tokens(empty, workspace(spark, "test"))).count() == 0


def test_several_files_a_task(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).coalesce(1)
    monkeypatch.setattr(token_files, "FILE", 2000)
    monkeypatch.setattr(token_files, "BLOCK", 700)
    files = token_files.write_tokens(docs, workspace(spark, "test"))
    assert read_file(files.first()["file"])[:8] == rans.MAGIC
    got = token_files.read_tokens(files).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert files.select("file").distinct().count() > 3 and files.count() > files.select("file").distinct().count()
    some = files.where("nr % 3 = 1")  # any blocks can be read without the others
    assert token_files.read_tokens(some.withColumn("before", F.col("before"))).count() == some.agg(F.sum("n_docs")).first()[0]


def test_words_as_the_library():
    import random

    w = token_files.Words(public_tokenizers.path(token_files.VOCABULARY))
    w.LIMIT = 3000
    rng = random.Random(4)
    parts = [*"abc'sÉİΣσ.,!  \n\t12é<|>日本 ́　x-", "<|endoftext|>", "'ll ", "</w>", "ſ", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    got = [x.tolist() for i in range(0, len(texts), 100) for x in w.encode(pa.array(texts[i : i + 100]))]
    assert got == [e.ids + [1] for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]
