"""Token ids of all documents in files of the shared folder, ordered by doc_id, and their readers.

Documents are range-partitioned and sorted by doc_id, encoded, and written by each task to files of its own, in
the format of rans.py; a file ends after FILE tokens. Names carry the attempt that wrote them, and the list of their blocks is a
table that Spark commits, so files of lost or repeated attempts are never read. Reading deals out blocks: a task reads a file's
head and the bytes of its own blocks, and decodes them by themselves.

No token goes across white space, so words are encoded once by the tokenizer and kept in a bounded cache.

Defined results: a null text counts as empty and has the end id only; null doc_ids come last; rows that share a doc_id
follow one another in the order of a hash of their texts; a very long text is a block of its own; an empty table gives no files and an empty result; other columns
are never read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import only, read_part, slices, splits, staged, table, text_of, workspace, write_file
from .word_ids import WordIds

VOCABULARY = "word_bpe_49k.json"
END = 1  # appended to each document
FILE = 1 << 23  # tokens after which a task starts another file
BLOCK = rans.BLOCK


class Words(WordIds):
    """Ids of words, and those of texts put together from them."""

    LIMIT = 1_000_000
    JOINED = 1000
    SIGNS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"  # no apostrophe: some words start with one

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a run of letters or signs
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        super().__init__()

    def runs(self, word: str) -> int:
        """1: letters only, 2: letters and then signs, 0: anything else."""
        if word.isalpha():
            return int(word.lower().isalpha())  # some letters have a mark apart in lower case
        body = word.rstrip(self.SIGNS)
        return 2 * int(body.isalpha() and body.lower().isalpha())

    def _several(self, words: list[str], runs: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of so many runs each, encoded together, and their numbers; None if the ends of words can't be told."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != runs * len(words) or ends[-1] != len(ids) - 1:
            return None
        return ids, np.diff(ends[runs - 1 :: runs], prepend=-1)

    def learn(self, words: list[str]) -> None:
        """Many calls cost more than many words, so words of one form are encoded together."""
        forms: tuple[list[str], ...] = ([], [], [])
        for w in words:
            forms[self.runs(w)].append(w)
        for runs in (1, 2):
            for a in range(0, len(forms[runs]), self.JOINED):
                some = forms[runs][a : a + self.JOINED]
                if (got := self._several(some, runs)) is None:
                    forms[0].extend(some)
                else:
                    self.put(some, *got)
        if forms[0]:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(forms[0], add_special_tokens=False)]
            self.put(forms[0], np.array(list(chain.from_iterable(got)), np.uint32), np.array(list(map(len, got)), np.int64))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id. Arrow splits the texts and numbers their different words."""
        flat, cuts = self.joined(pc.ascii_split_whitespace(texts.cast(pa.large_string())))  # an empty word before leading and after trailing white space
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out = np.empty(b - a + 1, np.uint32)
            out[:-1] = flat[a:b]
            out[-1] = END
            yield out


_loaded: dict[str, Words] = {}


def words(path: str) -> Words:
    """One vocabulary a process."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> DataFrame:
    """Write all documents' ids below path; the list of blocks: part, nr, file, head, at, n_bytes, n_docs, n_tokens, before (tokens of its part)."""
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), words(vocabulary)
        only(coder)
        held: list[tuple[int | None, np.ndarray]] = []
        n = place = nr = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n, place, nr, before
            data = rans.pack_file(held, BLOCK)
            name = f"{path}/tokens/{part:06d}-{place:04d}-{uuid.uuid4().hex}.rans"
            write_file(name, data)
            head, blocks = rans.layout(data)
            rows = []
            for at, size, tokens, documents in blocks:
                rows.append({"part": part, "nr": nr, "file": name, "head": head, "at": at, "n_bytes": size, "n_docs": documents, "n_tokens": tokens, "before": before})
                nr, before = nr + 1, before + tokens
            held, n, place = [], 0, place + 1
            return pa.RecordBatch.from_pylist(rows, schema=LISTED)

        for batch in slices(batches, rows=10000, size=16 << 20):
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1)), strict=True):
                held.append((doc_id, ids))
                n += len(ids)
                if n >= FILE:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), splits(rows) or 0)
    order = F.col("doc_id").asc_nulls_last()
    sorted_rows = rows.repartitionByRange(parts, order).sortWithinPartitions(order, F.xxhash64("text"))
    return staged(sorted_rows.mapInArrow(run, "part int, nr long, file string, head long, at long, n_bytes long, n_docs long, n_tokens long, before long"), f"{path}/blocks")


LISTED = pa.schema(
    [("part", pa.int32()), ("nr", pa.int64()), ("file", pa.string()), ("head", pa.int64()), ("at", pa.int64()), ("n_bytes", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())]
)
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_tokens(blocks: DataFrame) -> DataFrame:
    """From the list of blocks: doc_id, start, n_tokens, ids_crc32, all decoded from the files."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a writing task
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    placed = blocks.join(parts, "part").select("file", "head", "at", "n_bytes", (F.col("base") + F.col("before")).alias("start"))
    spark = blocks.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = coder = None
        for batch in batches:
            for file, head, at, size, start in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if file != name:
                    name, coder = file, rans.head(read_part(file, 0, head))
                doc_ids, lengths, tokens = rans.unpack_block(coder, rans.checked(read_part(file, at, size)))
                data = memoryview(tokens.astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], schema=READ)

    dealt = placed.repartition(width, "start").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), workspace(spark, "tokens")))
