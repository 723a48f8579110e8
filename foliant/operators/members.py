"""Which names an index doesn't have: Bloom filters first, then an exact look at the names that may be there.

A run's filter is a table of blocks of 32,768 bits, one block for NAMES_A_BLOCK names. A name's bits are all in one block, so it is
looked up by an equality join. Names that no run's filter shows aren't in the index, and the catalogue isn't read for them; the others
are compared with the names of those runs whose filters have shown any. All of it is built-in expressions and aggregates.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .index import Snapshot

NAMES = "block long, bits binary"
BITS = 32_768  # of a bitmap that Spark's aggregate makes
NAMES_A_BLOCK = 2_000  # so a name that isn't there is shown about once in 2,000 times
NAMES_A_TASK = 50_000  # whose bits a task sorts
PROBES = 7


def _places(name: Column, blocks: int | Column) -> tuple[Column, Column]:
    """A name's block, and the places of its bits there: two halves of one hash give them all."""
    h = F.xxhash64(name)
    low, high = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    block = F.pmod(F.xxhash64(name, F.lit(1)), blocks)
    return block, F.array(*[F.pmod(low + high * F.lit(i) + F.lit(i * i), F.lit(BITS)) for i in range(PROBES)])


def write_filter(names: DataFrame, n_names: int, path: str) -> int:
    """Write the filter of so many names; the number of its blocks."""
    if not n_names:
        return 0
    blocks = -(-n_names // NAMES_A_BLOCK)
    block, places = _places(F.col("name"), blocks)
    dealt = names.select(block.alias("block"), places.alias("places")).repartition(-(-n_names // NAMES_A_TASK), "block")  # before a row is made of each place
    bits = dealt.select("block", F.explode("places").alias("place")).groupBy("block").agg(F.bitmap_construct_agg(F.col("place")).alias("bits"))
    bits.sortWithinPartitions("block").write.parquet(path)  # dealt by block already
    return blocks


def _has(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def shown(snapshot: Snapshot, names: DataFrame) -> DataFrame:
    """run, name of the names that a run's filter shows. All that the index has are among them."""
    found = None
    for i, run in enumerate(r for r in snapshot.runs if r.filters):
        block, places = _places(F.col("name"), run.filters)
        asked = names.select("name", block.alias("block"), places.alias("places"))
        bits = snapshot.table("names", NAMES, [run])
        some = asked.join(bits, "block").where(F.forall("places", lambda p: _has(F.col("bits"), p))).select(F.lit(run.id).alias("run"), "name")
        found = some if i == 0 else found.union(some)
    return names.sparkSession.createDataFrame([], "run string, name string") if found is None else found


def unknown(snapshot: Snapshot, names: DataFrame, staging: str) -> tuple[DataFrame, bool]:
    """Rows of names whose name the catalogue doesn't have, and whether these are all: names that only filters show need no join."""
    if not any(r.filters for r in snapshot.runs):
        return names, True
    names.write.parquet(f"{staging}/asked")
    names = names.sparkSession.read.schema(names.schema).parquet(f"{staging}/asked")
    shown(snapshot, names.select("name")).write.parquet(f"{staging}/shown")
    some = names.sparkSession.read.schema("run string, name string").parquet(f"{staging}/shown")
    runs = {r["run"] for r in some.select("run").distinct().collect()}  # as many as there are runs
    if not runs:
        return names, True
    has = snapshot.rows([r for r in snapshot.runs if r.id in runs]).where("error is null").select("name")
    some.select("name").distinct().join(has, "name", "left_semi").write.parquet(f"{staging}/known")
    known = names.sparkSession.read.schema("name string").parquet(f"{staging}/known")
    if not known.head(1):
        return names, True
    return names.join(known, "name", "left_anti"), False
