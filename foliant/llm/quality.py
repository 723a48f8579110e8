r"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse scoring.

Words are split at ASCII white space. Each position gives a word, its shape (case and trailing signs), and the pairs of
words and of shapes with the position before; a word equal to the one before has a shape of its own, so that
runs of one word show. All n-grams are hashed to 2**BITS features; a document is the vector of their frequencies
a word, and its score the logistic function of a sparse dot product.

The model is fitted on at most `sample` labelled rows, those with the smallest hash of doc_id among rows that aren't
held out, and on fewer if their vectors together have more than BYTES bytes; texts are turned to features on the executors, so
that the driver gets whole sparse vectors of a bounded number of documents and bytes. Scoring reads every row and whole texts, many at a time.

Defined results: a null or empty text has no features and gets the score of the bias; a null doc_id is passed on and
never trained on (its held_out is null); rows without a label, or with a null one, are not trained on; of several labels
of a doc_id the largest counts; a very long text is scored as a whole; with no labels at all every score is 0.5; repeated rows are scored alike; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, only, slices, spread, table, text_of

BITS = 20
SAMPLE = 5000  # labelled rows to fit on, at most
BYTES = 64 << 20  # of their vectors, at most: with longer texts, fewer rows
HELD = 1 << 19  # bytes of text that are scored together; n-grams take some 60 times as much
THRESHOLD = 0.3
EPOCHS = 4
SCALE = 8.0
MIX = np.uint64(0x9E3779B97F4A7C15)
SEEDS = [np.uint64(s) for s in (0x51ED270B0A1C6A25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
TAIL = re.compile(rb"[^A-Za-z0-9\x80-\xff]*\Z")


def shape(word: bytes) -> bytes:
    """Case of the letters, and the signs at the end."""
    text = word.decode(errors="replace")
    letters = [c for c in text if c.isalpha()]
    upper = sum(map(str.isupper, letters))
    case = "-" if not letters else "a" if not upper else "A" if upper == len(letters) > 1 else "T" if upper == 1 and letters[0].isupper() else "x"
    digit = "9" if any(map(str.isdigit, text)) else ""
    return f"{case}{digit}".encode() + TAIL.search(word)[0][:4]


class Hashes(dict):
    """Word to the hashes of itself and its shape, kept for the words seen last."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = (xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(shape(word), seed=7))
        return found


KNOWN = Hashes()
SAME = np.uint64(0x2545F4914F6CDD1D)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A feature number for each n-gram of some texts, repeats included; which text has it; and how many words each text has."""
    words = [t.encode().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    both = np.fromiter(map(KNOWN.__getitem__, chain.from_iterable(words)), np.dtype((np.uint64, 2)), n).reshape(n, 2)
    word, form = both[:, 0], both[:, 1].copy()
    first = np.zeros(n + 1, bool)
    first[np.concatenate([[0], np.cumsum(sizes)])] = True
    joins = ~first[1:n]  # places where a word and the next are in one text
    form[1:][(word[1:] == word[:-1]) & joins] = SAME
    at = np.flatnonzero(joins)
    mixed = np.concatenate([word * SEEDS[0], form * SEEDS[1], (word[at] * SEEDS[2] ^ word[at + 1]) * SEEDS[3], (form[at] * SEEDS[3] ^ form[at + 1]) * SEEDS[2]])
    mixed ^= mixed >> np.uint64(29)
    mixed *= MIX
    text = np.repeat(np.arange(len(texts)), sizes)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([text, text, text[at], text[at]]), sizes


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sparse vector: feature numbers, ascending, and SCALE times their frequency a word."""
    at, _, n = grams_of([text])
    at, counts = np.unique(at, return_counts=True)
    return at.astype(np.int32), (counts * (SCALE / max(1, int(n[0])))).astype(np.float32)


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class FTRL:
    """Per-coordinate follow-the-regularised-leader-proximal for logistic loss; coordinate -1 is the bias."""

    def __init__(self, size: int = 1 << BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        held = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, held)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (logistic(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def dense(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z))).astype(np.float32)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only(KNOWN)
    for batch in slices(batches, size=HELD):
        made = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary()), batch.column(2)], names=["doc_id", "at", "x", "label"]
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = BYTES) -> np.ndarray:
    """The weights; the last one is the bias. labels: doc_id, quality. Of labelled rows, those with the smallest hashes are learnt from: at
    most `sample` of them, and no more than have vectors of `held` bytes together. Each is learnt with all its features."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented bound of the sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    vectors = rows.select("doc_id", "text", "label").mapInArrow(_vectors, "doc_id long, at binary, x binary, label int")
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # over the sample
    vectors = vectors.withColumn("upto", F.sum(F.octet_length("at") + F.octet_length("x")).over(upto)).where(F.col("upto") <= held)
    got = vectors.toArrow()
    data = sorted(set(zip(*(got.column(i).to_pylist() for i in range(4)), strict=True)))
    examples = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), y) for _, a, x, y in data]
    model, order = FTRL(), np.random.default_rng(9)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            model.learn(*examples[i])
    weights = model.dense()
    del got, data, examples, model
    give_back()  # the driver's memory, which its JVM needs
    return weights


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The logistic function of the dot products with features(), for many texts at once: each n-gram adds its weight once."""
    only(KNOWN)
    at, text, words = grams_of(texts)
    sums = np.bincount(text, weights[at].astype(np.float64), len(texts))
    return logistic(sums * SCALE / np.maximum(1, words) + float(weights[-1]))


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=HELD):
            yield pa.record_batch([batch.column(0), pa.array(scores(batch.column(1).to_pylist(), sent.value), pa.float64())], names=["doc_id", "score"])

    rows = spread(docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = slices(iter([pa.record_batch([texts], names=["text"])]), size=HELD)
            yield pa.array(np.concatenate([np.empty(0), *(scores(part.column(0).to_pylist(), sent.value) for part in parts)]), pa.float64())
        give_back()

    return spread(docs).where(scored(text_of()) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
