"""Exact duplicates through an extendible-hash index kept on shared files. DataFrame operations only.

A text's key is a 64-bit hash of its normalised form. The directory leads from the leading bits of a key to a bucket: it doubles
as long as a bucket holds more keys than its capacity, and only overfull buckets split, so buckets are ranges of keys of
different depths. Bits are counted in rounds, each of them deeper and only over the keys of buckets that are still overfull; a
bucket that holds one key alone doesn't split, so there is always an end, and no depth is too deep.

1. Rows are reduced to (doc_id, key, digest), and keys counted. The directory is made from the keys.
2. A key that occurs once needs no comparison. Rows of the others are led through the directory to their bucket, and those of
   equal bytes are combined where they are and then by a hash of the bytes, so a group of any size becomes one row. These rows go
   to the tasks that own their buckets, a range of buckets each and each bucket in one task, which compare the bytes of all
   texts of a key: different ones are chained, each an entry with a place in the chain.
3. The index is written in ranges of buckets: bucket, key, chain, keep_id, group_size, and the text of entries that are chained.
4. Each row looks its entry up by slot, bucket and key; where an entry is chained, by comparing bytes once more.

Keys with more than one 65,536th of all rows, and more than 64, are looked up in a broadcast table, which has fewer than 65,536 rows
therefore; the rows of all others are spread by key. A bucket holds CAPACITY keys or, in tables of more than 2**32 keys, a 65,536th of
them, so that the directory stays small enough to be broadcast.

Defined results: a null text counts as empty; a null doc_id ranks after all others and, if a group has no
doc_id at all, every row of it is kept; rows that repeat both doc_id and text are one document and share
its verdict; a very long text is compared as a whole; an empty table gives an empty result; other columns may have any name
and are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, spread_join, staged, table, text_of, workspace

CAPACITY = 256  # keys a bucket may hold before it is split
PARTS = 1 << 16  # of all rows or keys: what is larger is treated apart
LEAST = 64  # rows of a key that is, in small tables
STEP = 8  # bits by which a round goes deeper

Key = Callable[[Column], Column]


def normalised(text: str | Column = "text") -> Column:
    """Runs of white space become one space. Single spaces don't match, which spares most replacements."""
    return F.regexp_replace(text_of(text), f"[{SPACE}]{{2,}}|[\t-\r]", " ")


def prefix(key: Column | str, depth: int) -> Column:
    """The leading bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, n_keys: int, path: str, capacity: int = CAPACITY) -> list[tuple[int, DataFrame]]:
    """From distinct keys: levels of the directory, each its depth and a table of slot, bucket, local_depth, n_keys.

    A slot of a level leads to a bucket or, where bucket is null, to the next level. A bucket's name is the least key that it may
    hold, in hexadecimal digits, so names sort as ranges do.
    """
    capacity = max(capacity, n_keys // PARTS)
    before, depth = -1, (n_keys // capacity).bit_length() + 1  # 2**18 slots at most, as n_keys // capacity is 2**16 at most
    levels, open_ = [], keys.select("key")
    while True:
        cells = open_.groupBy(prefix("key", depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        # every cell as part of the buckets it would be in after each doubling
        doubled = cells.withColumn("d", F.explode(F.sequence(F.lit(before + 1), F.lit(depth)))).withColumn("at", F.expr(f"shiftrightunsigned(slot, {depth} - d)"))
        held = doubled.groupBy("d", "at").agg(F.sum("n").alias("held"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = held.where((F.col("held") <= capacity) | (F.col("lo") == F.col("hi"))).select("d", "at", "held")
        ends = doubled.select("slot", "d", "at").join(fits, ["d", "at"]).groupBy("slot").agg(F.min(F.struct("d", "at", "held")).alias("end"))
        name = F.lpad(F.hex(F.expr("shiftleft(end.at, 64 - end.d)")), 16, "0")
        level = staged(
            cells.select("slot").join(ends, "slot", "left").select("slot", F.when(F.col("end").isNotNull(), name).alias("bucket"), F.col("end.d").alias("local_depth"), F.col("end.held").alias("n_keys")),
            f"{path}/directory-{depth}",
        )
        levels.append((depth, level))
        overfull = level.where("bucket is null").select("slot")
        if not overfull.head(1):
            return levels
        open_ = staged(open_.withColumn("slot", prefix("key", depth)).join(overfull, "slot", "left_semi").select("key"), f"{path}/overfull-{depth}")
        before, depth = depth, min(64, depth + STEP)


def led(rows: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """Rows with a column key, and their bucket by the directory."""
    for i, (depth, level) in enumerate(levels):
        slots = level.select(F.col("slot").alias(f"_slot{i}"), F.col("bucket").alias(f"_bucket{i}"))
        slots = slots if i else F.broadcast(slots)  # 2**18 rows at most; of deeper levels Spark sees the size
        rows = rows.withColumn("_at", prefix("key", depth)).join(slots, F.col("_at") == F.col(f"_slot{i}"), "left").drop("_at", f"_slot{i}")
    found = [f"_bucket{i}" for i in range(len(levels))]
    return rows.withColumn("bucket", F.coalesce(*found)).drop(*found)


def looked_up(rows: DataFrame, entries: DataFrame, n_rows: int) -> DataFrame:
    """Rows (bucket, key and others) with the other columns of their entry (bucket, key, n and others), or nulls; n: how many rows it has."""
    return spread_join(rows, entries, ["bucket", "key"], "n", max(LEAST, n_rows // PARTS), ["doc_id"])  # so fewer than PARTS entries are broadcast


class ExactIndex:
    """The index of a table's texts below a folder."""

    def __init__(self, docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", key: Key = F.xxhash64):
        self.path, self.key = path, key
        self.texts = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm")).withColumn("key", key(F.col("norm")))
        self.rows = staged(self.texts.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), f"{path}/rows")
        keys = staged(self.rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), f"{path}/keys")
        counts = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.n_keys, self.n_rows = counts
        self.levels = directory(keys, self.n_keys, path, capacity)
        self.entries = self._built(led(keys, self.levels))

    def owned(self, keys: DataFrame) -> DataFrame:
        """Different texts of keys that occur again, in the tasks that own their buckets: bucket, key, norm, keep_id, group_size, chain, length (of the chain)."""
        again = keys.where("n > 1").select("bucket", "key", "n")
        met = looked_up(led(self.texts, self.levels), again, self.n_rows).where("n is not null")
        combined = staged(met.groupBy("bucket", "key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), f"{self.path}/combined")
        dealt = combined.repartitionByRange("bucket").sortWithinPartitions("bucket", "key", "norm")  # a bucket isn't cut
        chain, length = (F.expr(f"{f} over (partition by bucket, key{order})") for f, order in (("row_number()", " order by norm"), ("count(*)", "")))
        return dealt.withColumn("chain", chain - 1).withColumn("length", length)

    def _built(self, keys: DataFrame) -> DataFrame:
        text = F.when(F.col("length") > 1, F.col("norm"))  # with 64 bits this hardly ever happens
        repeated = self.owned(keys).select("bucket", "key", "chain", "keep_id", "group_size", text.alias("text"))
        alone = keys.where("n = 1").select("bucket", "key", F.lit(0).alias("chain"), F.col("least").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(None).cast("string").alias("text"))
        built = staged(repeated.union(alone).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain"), f"{self.path}/index")
        self.chained = bool(built.where("text is not null").head(1))
        return built

    def verdicts(self, rows: DataFrame, text: str | None = None) -> DataFrame:
        """Rows (doc_id, key and others) with keep_id and group_size. text: a column that has the normalised text; without one it is read again if entries are chained."""
        entries = self.entries.where("group_size > 1 or text is not null")
        plain = entries.where("text is null").select("bucket", "key", F.col("group_size").alias("n"), "keep_id", "group_size")
        found = looked_up(led(rows, self.levels), plain, self.n_rows).drop("n")
        if self.chained:  # bytes decide among the entries of a chain
            chained = entries.where("text is not null").select(F.col("bucket").alias("_cb"), F.col("key").alias("_ck"), F.col("text").alias("_text"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
            found = found.join(chained, (found["bucket"] == F.col("_cb")) & (found["key"] == F.col("_ck")) & (found[text] == F.col("_text")), "left")
            found = found.withColumn("keep_id", F.coalesce("keep_id", "_keep")).withColumn("group_size", F.coalesce("group_size", "_size")).drop("_cb", "_ck", "_text", "_keep", "_size")
        size = F.coalesce("group_size", F.lit(1)).cast("long")
        return found.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", size)


def build_index(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", key: Key = F.xxhash64) -> DataFrame:
    """Write the index below path. Columns: bucket, key, chain, keep_id, group_size, text (of chained entries)."""
    return ExactIndex(docs, path, capacity, doc_id, text, key).entries


def exact_groups(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", key: Key = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = ExactIndex(docs, path or workspace(docs.sparkSession, "exact"), capacity, doc_id, text, key)
    rows = index.texts.withColumn("text_sha256", F.sha2("norm", 256)) if index.chained else index.rows
    return index.verdicts(rows, "norm").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: Key = F.xxhash64) -> DataFrame:
    """The documents that stay, with all their columns."""
    index = ExactIndex(docs, path or workspace(docs.sparkSession, "exact"), capacity, key=key)
    norm = normalised(F.col("row.text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), key(norm).alias("key"), *([norm.alias("norm")] if index.chained else []))
    kept = index.verdicts(rows, "norm").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
