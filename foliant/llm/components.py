"""Connected components of a table of links, by alternating large and small stars.

Every round replaces links by links to smaller neighbours, until each component is a star around its smallest node. Rounds are
written to the shared folder; only a count and a checksum of the links come to the driver. Nodes with many links, star centres
above all, are looked up in a broadcast table of at most 2 * PARTS rows, so that their links stay spread.

Defined results: links to itself and repeated ones count for nothing; a link with a null end is left out; no links give an empty
table; other columns are never read.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged

PARTS = 4096
LEAST = 64


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())


def components(links: DataFrame, path: str) -> DataFrame:
    """From (a, b): node, component, for every node that has a link to another and isn't the smallest of its component."""
    links = links.where("a is not null and b is not null")
    edges = staged(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), f"{path}/0")
    before = _sum(edges)
    for i in count(1):
        if not before[0]:
            break
        limit = max(LEAST, before[0] // PARTS)  # nodes with more links than that are few
        # large star: the larger neighbours of each node are linked to its smallest neighbour (or itself)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both.where("v > u"), least, ["u"], "n", limit, ["u", "v"]).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = staged(large.distinct(), f"{path}/{i}-large")
        # small star: each node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        met = spread_join(large, least, ["hi"], "n", limit, ["hi", "lo"])
        small = met.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(least.select("hi", F.col("m").alias("lo"))).distinct()
        edges = staged(small, f"{path}/{i}")
        after = _sum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
