r"""Passages that repeat within and across documents, found by difference-cover anchors.

COVER is a difference cover modulo PERIOD: every difference of two positions is, modulo PERIOD, a difference of two of its
elements. So if the same WINDOW words stand at two places, then for some offset below PERIOD both places, moved by it, are cover
positions, and the ANCHOR = WINDOW - PERIOD + 1 words from there on are the same and lie within the window. Hence hashing the
ANCHOR words at cover positions only (4 of 13) loses no match, whatever the two places are.

1. Documents are sorted by (doc_id, text) and cut into chunks of consecutive ones, whose words are numbered and written as files to
   the shared folder. So the order of chunks, and within a chunk of words, is that of documents: no ids travel with hashes.
2. Each chunk gives the different hashes of its anchors, dealt to buckets. A hash is repeated if it occurs twice in a chunk, which
   the chunk knows, or in two chunks, which the bucket finds. Chunks get a bit for each hash that they gave.
3. Anchors that are repeated extend to the windows that contain them. Windows are compared by 128 bits, in the same way: a window
   repeats an earlier one if it isn't the first of its chunk, or if an earlier chunk has it too.
4. Words that such a window covers go.

A chunk gives each hash once, so a passage in a third of all rows costs a bucket one entry a chunk, which stands for 16 MB of text.
Buckets hold about HELD entries each, by number, as hashes are even. Nothing is capped, and no pairs are made.

Defined results: a null or empty text has no words; documents shorter than WINDOW keep all; very long texts go whole into a chunk;
rows without doc_id come last; of rows that share a doc_id, the order of their texts' hashes decides which is the earlier, and of
repeated rows all but one repeat the other; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, read_file, slices, splits, staged, table, text_of, workspace, write_file

WINDOW = 20  # words
PERIOD, COVER = 13, (0, 1, 3, 9)  # of which every difference modulo 13 is one
ANCHOR = WINDOW - PERIOD + 1
CHUNK = 16 << 20  # bytes of text
PART = 4 << 20  # of which words are split at a time
HELD = 1 << 18  # entries of a bucket, about

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
CHUNKS = "part int, nr int, file string, n_docs long, n_words long"
SENT = "bucket int, part int, nr int, hashes binary"
BITS = "part int, nr int, bucket int, bits binary"


# Chunks of documents, their words numbered.


class Chunk:
    """Consecutive documents: their ids, how many words each has, the different words, and the numbers of all words."""

    def __init__(self, doc_ids: list[int | None], sizes: np.ndarray, words: list[bytes], codes: np.ndarray):
        self.doc_ids, self.sizes, self.words, self.codes = doc_ids, sizes, words, codes
        self.ends = np.cumsum(sizes)

    @classmethod
    def of(cls, doc_ids: list[int | None], texts: list[pa.Array]) -> Chunk:
        """Texts come in parts, of which each is split and numbered by Arrow."""
        number: dict[bytes, int] = {}
        codes, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for part in texts:
            lists = pc.ascii_split_whitespace(part.cast(pa.large_string()))
            flat = lists.flatten()
            coded = flat.dictionary_encode()
            names = [w.encode() for w in coded.dictionary.to_pylist()]
            to = np.array([number.setdefault(w, len(number)) if w else -1 for w in names] or [0], np.int32)
            at = to[coded.indices.to_numpy()]
            offsets = lists.offsets.to_numpy()
            full = np.concatenate([[0], np.cumsum(at >= 0)])  # white space at the ends gives empty words
            sizes.append(np.diff(full[offsets - offsets[0]]))
            codes.append(at[at >= 0])
        return cls(doc_ids, np.concatenate(sizes).astype(np.int64), list(number), np.concatenate(codes))

    def packed(self) -> bytes:
        out = io.BytesIO()
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.large_list(pa.large_binary()), pa.large_list(pa.int32())]
        row = pa.record_batch([pa.array([x], k) for x, k in zip((self.doc_ids, self.sizes, self.words, self.codes), kinds, strict=True)], names=["doc_ids", "sizes", "words", "codes"])
        with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(row)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Chunk:
        row = pa.ipc.open_stream(data).read_next_batch()
        return cls(row.column(0)[0].as_py(), row.column(1).flatten().to_numpy(), row.column(2)[0].as_py(), row.column(3).flatten().to_numpy())

    # Hashes. Words have hashes of their own; a run of words has a polynomial of them, from running sums.

    def _runs(self, at: np.ndarray, length: int, one: int) -> np.ndarray:
        """Of the runs of so many words that begin at these places, a hash; one of two."""
        h = np.fromiter((xxhash.xxh64_intdigest(w, one) for w in self.words), U, len(self.words))[self.codes]
        n = len(h)
        up, down = (_powers(b, n) for b in (BASES[one], INVERSES[one]))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(h * down, dtype=U)])
        x = (sums[at + length] - sums[at]) * up[at]
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))

    def _fits(self, length: int) -> np.ndarray:
        """Of each place, whether a run of so many words that begins there lies in its document."""
        left = np.repeat(self.ends, self.sizes) - np.arange(len(self.codes))
        return left >= length

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of anchors, and their hashes."""
        cover = np.isin(np.arange(PERIOD), COVER)
        at = np.flatnonzero(self._fits(ANCHOR) & np.resize(cover, len(self.codes)))
        return at, self._runs(at, ANCHOR, 0)

    def windows(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows that contain one of these anchors, and their hashes: two a window."""
        steps = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(steps, np.maximum(anchors - (PERIOD - 1), 0), 1)
        np.add.at(steps, anchors + 1, -1)
        at = np.flatnonzero((np.cumsum(steps[:-1]) > 0) & self._fits(WINDOW))
        return at, np.stack([self._runs(at, WINDOW, one) for one in (0, 1)], 1)

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """Of each word, whether one of these windows covers it."""
        steps = np.zeros(len(self.codes) + 1, np.int64)
        steps[windows] += 1
        steps[windows + WINDOW] -= 1
        return np.cumsum(steps[:-1]) > 0


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, 2 and so on, modulo 2 ** 64."""
    out = np.full(n + 1, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)[: max(n, 1)]


def chunks(docs: DataFrame, path: str) -> DataFrame:
    """Write all documents below path; the list of chunks: part, nr, file, n_docs, n_words. The order of (part, nr) is that of documents."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nr = TaskContext.get().partitionId(), 0
        doc_ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, texts, size, nr
            chunk = Chunk.of(doc_ids, texts)
            name = f"{path}/chunks/{part:06d}-{nr:04d}-{uuid.uuid4().hex}"
            write_file(name, chunk.packed())
            row = {"part": part, "nr": nr, "file": name, "n_docs": len(doc_ids), "n_words": len(chunk.codes)}
            doc_ids, texts, size, nr = [], [], 0, nr + 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("nr", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_words", pa.int64())]))

        for batch in slices(batches, rows=1 << 20, size=PART):
            doc_ids.extend(batch.column(0).to_pylist())
            texts.append(batch.column(1))
            size += batch.column(1).nbytes
            if size >= CHUNK:
                yield flush()
        if doc_ids:
            yield flush()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), splits(rows) or 0)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return staged(dealt.mapInArrow(run, CHUNKS), f"{path}/list")


# Hashes meet in buckets, and chunks learn of each of theirs whether others have it.


def _entries(part: int, nr: int, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A chunk's different hashes (rows, the first column ascending) by bucket: ranges of the first column."""
    first = hashes if hashes.ndim == 1 else hashes[:, 0]
    cuts = _cuts(first, buckets)
    some = np.flatnonzero(np.diff(cuts))
    blobs = [hashes[cuts[b] : cuts[b + 1]].tobytes() for b in some.tolist()]
    return pa.record_batch([pa.array(some, pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array([nr] * len(some), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "part", "nr", "hashes"])


def _cuts(ascending: np.ndarray, buckets: int) -> np.ndarray:
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], U)
    return np.concatenate([[0], np.searchsorted(ascending, edges), [len(ascending)]])


def _met(batches: Iterator[pa.RecordBatch], width: int, later: bool) -> Iterator[pa.RecordBatch]:
    """Rows of SENT, sorted by bucket, part, nr: for each of their hashes a bit, whether another chunk (an earlier one, if later) has it."""
    at, held = None, []

    def answers() -> Iterator[pa.RecordBatch]:
        lists = [np.frombuffer(x, U).reshape(-1, width) for _, _, x in held]
        lengths = [len(x) for x in lists]
        every = np.concatenate(lists)
        order = np.lexsort(every.T[::-1])  # stable: of equal hashes, the earliest chunk first
        same = (every[order[1:]] == every[order[:-1]]).all(1)
        yes = np.zeros(len(every), bool)
        yes[order[1:]] = same
        if not later:
            yes[order[:-1]] |= same
        cuts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        found = [(p, n, np.packbits(yes[a:b]).tobytes()) for (p, n, _), a, b in zip(held, cuts[:-1], cuts[1:], strict=True) if yes[a:b].any()]
        yield pa.record_batch([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([at] * len(found), pa.int32()), pa.array([f[2] for f in found], pa.binary())], names=["part", "nr", "bucket", "bits"])

    for batch in batches:
        for bucket, part, nr, hashes in zip(*(batch.column(i) for i in range(4)), strict=True):
            if bucket.as_py() != at:
                if held:
                    yield from answers()
                at, held = bucket.as_py(), []
            held.append((part.as_py(), nr.as_py(), hashes.as_py()))
    if held:
        yield from answers()


def _bits_of(hashes: np.ndarray, buckets: int, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """Of each of a chunk's different hashes, the bit that its bucket gave; answers: bucket, bits."""
    cuts = _cuts(hashes if hashes.ndim == 1 else hashes[:, 0], buckets)
    out = np.zeros(len(hashes), bool)
    for bucket, bits in answers:
        n = int(cuts[bucket + 1] - cuts[bucket])
        out[cuts[bucket] : cuts[bucket + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out


def asked(sent: DataFrame, listed: DataFrame, width: int, later: bool, path: str) -> DataFrame:
    """The list of chunks with the answers of buckets (bucket, bits) to each."""
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "part", "nr")
    bits = dealt.mapInArrow(lambda batches: _met(batches, width, later), BITS)
    by_chunk = bits.groupBy("part", "nr").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))  # one a bucket: bits of the chunk's own hashes
    return staged(listed.join(by_chunk.hint("merge"), ["part", "nr"], "left"), path)  # answers grow with the input: never broadcast


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Chunk, list[list[tuple[int, bytes]]]]]:
    """part, nr, the chunk and its answers, of rows (part, nr, file, and columns of answers)."""
    for batch in batches:
        for part, nr, file, *answers in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            yield part, nr, Chunk.unpacked(read_file(file)), [[(a["bucket"], a["bits"]) for a in some or ()] for some in answers]
    give_back()


def _repeated(chunk: Chunk, buckets: int, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """Places of the anchors that are repeated."""
    at, hashes = chunk.anchors()
    different, back, n = np.unique(hashes, return_inverse=True, return_counts=True)
    yes = _bits_of(different, buckets, answers) | (n > 1)
    return at[yes[back]]


def _different(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows, ascending, and the first place of each."""
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    ordered = hashes[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)]) if len(order) else np.empty(0, bool)
    return ordered[new], order[new]


def _removed(chunk: Chunk, anchor_buckets: int, anchor_bits: list, window_buckets: int, window_bits: list) -> np.ndarray:
    """Of each word, whether it goes."""
    at, hashes = chunk.windows(_repeated(chunk, anchor_buckets, anchor_bits))
    different, first = _different(hashes)
    goes = np.ones(len(at), bool)
    goes[first] = _bits_of(different, window_buckets, window_bits)
    return chunk.covered(at[goes])


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def without_repeats(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept: the words that stay, joined by a space, or their SHA-256 if digest."""
    path = path or workspace(docs.sparkSession, "passages")
    listed = chunks(docs, path)
    n = listed.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(1, -(-n * len(COVER) // (PERIOD * HELD)))
    spread = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = listed.select("part", "nr", "file").repartitionByRange(spread, "part", "nr")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, nr, chunk, _ in _opened(batches):
            yield _entries(part, nr, np.unique(chunk.anchors()[1]), buckets)

    known = asked(places.mapInArrow(anchors, SENT), listed, 1, False, f"{path}/anchors").withColumnRenamed("answers", "anchors")
    wide = buckets * 2  # there may be three windows an anchor, but most anchors occur once

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, nr, chunk, (answers,) in _opened(batches):
            _, hashes = chunk.windows(_repeated(chunk, buckets, answers))
            yield _entries(part, nr, _different(hashes)[0], wide)

    places = known.select("part", "nr", "file", "anchors").repartitionByRange(spread, "part", "nr")
    known = asked(places.mapInArrow(windows, SENT), known, 2, True, f"{path}/windows")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, chunk, (of_anchors, of_windows) in _opened(batches):
            gone = _removed(chunk, buckets, of_anchors, wide, of_windows)
            rows: list[list] = [[], [], [], []]
            held = 0
            for doc_id, end, size in zip(chunk.doc_ids, chunk.ends.tolist(), chunk.sizes.tolist(), strict=True):
                mine = gone[end - size : end]
                kept = b" ".join([chunk.words[c] for c in chunk.codes[end - size : end][~mine].tolist()])
                for column, x in zip(rows, (doc_id, size, int(mine.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode()), strict=True):
                    column.append(x)
                held += len(rows[3][-1])
                if held >= PART:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(rows, KEPT, strict=True)], schema=KEPT)
                    rows, held = [[], [], [], []], 0
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(rows, KEPT, strict=True)], schema=KEPT)

    places = known.select("part", "nr", "file", "anchors", "answers").repartitionByRange(spread, "part", "nr")
    return places.mapInArrow(texts, "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM words WHERE len(w) >= 20
), hashed AS MATERIALIZED (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS g FROM windows
), again AS (
  SELECT doc_id, p FROM hashed QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1
), gone AS (
  SELECT DISTINCT doc_id, p + j AS i FROM again, range(20) r(j)
), every AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
