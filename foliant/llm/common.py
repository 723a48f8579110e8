"""What the training-data operators share: inputs, the shared folder, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts write it, [\x20\x09-\x0D]; bytes.split() splits at the same six characters.
SPACE = " \t-\r"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def splits(df: DataFrame) -> int | None:
    """The number of partitions of a plan without a shuffle; None for others, whose number only running them tells."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return None if "Exchange" in plan or "AdaptiveSparkPlan" in plan else df._jdf.rdd().getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer splits than cores over all cores; larger scans and shuffled tables stay as they are."""
    cores, n = df.sparkSession.sparkContext.defaultParallelism, splits(df)
    return df.repartition(cores) if n is not None and n < cores else df


def text_of(col: str | Column = "text") -> Column:
    """The whole text, a null counting as empty."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="foliant-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def workspace(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one for one run of an operator."""
    return f"{shared_dir(spark)}/foliant-{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and outlives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    store, where = filesystem(path)
    with contextlib.suppress(FileNotFoundError):
        store.delete_dir(where)


def spread_join(rows: DataFrame, entries: DataFrame, on: list[str], size: str, limit: int, by: list[str]) -> DataFrame:
    """rows with the other columns of their entry, or nulls. entries: one row a key (on), and in the column size how many rows have it.

    Entries of more than `limit` rows are broadcast; callers see to it that there are few, as their rows are so many. The others
    meet their rows, at most `limit` of a key, in a sort-merge join at every size; rows that have found theirs are dealt out by a
    hash of the columns `by` meanwhile, in place of the last column of the key, which is a long. So no key's rows need to be in one task.
    """
    more = [c for c in entries.columns if c not in on]
    large = F.col(size) > F.lit(limit)
    hot = entries.where(large).select(*[F.col(c).alias(f"_h_{c}") for c in on], F.struct(*more).alias("_hot"))
    cold = entries.where(~large).select(*[F.col(c).alias(f"_c_{c}") for c in on], F.struct(*more).alias("_cold"))
    met = rows.join(F.broadcast(hot), reduce(and_, [F.col(c) == F.col(f"_h_{c}") for c in on]), "left")
    met = met.withColumn("_deal", F.when(F.col("_hot").isNotNull(), F.xxhash64(*by)).otherwise(F.col(on[-1])))
    same = reduce(and_, [F.col(c) == F.col(f"_c_{c}") for c in on[:-1]], F.col("_deal") == F.col(f"_c_{on[-1]}"))
    met = met.join(cold.hint("merge"), same & F.col("_hot").isNull(), "left")
    met = met.withColumn("_entry", F.coalesce("_hot", "_cold"))
    return met.select(*rows.columns, *[F.col(f"_entry.{c}").alias(c) for c in more if c not in rows.columns])


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """What opens files of the shared folder in Python, and the path there."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own and rename, so that no reader sees half a file."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}.part", compression=None) as out:
        out.write(data)
    store.move(f"{path}.part", path)


def read_file(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def read_part(uri: str, at: int, size: int) -> bytes:
    """Some bytes of a file, from a place on."""
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        return f.read_at(size, at)


_caches: list = []  # the one in use stands last


def only(cache) -> None:
    """Empty the other caches of this process: operators take turns in a Python worker, and each may fill its own.

    To be called from functions of a module, not from nested ones: those get a copy of the cache with each task.
    """
    if _caches and _caches[-1] is cache:
        return
    others = [c for c in _caches if c is not cache]
    for c in others:
        c.clear()
    _caches[:] = [*others, cache]
    give_back()


def give_back() -> None:
    """Return memory that was freed to the system; allocators keep it otherwise, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 2048, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has at most so many rows and about so many bytes of text."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            n = n or 0
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
