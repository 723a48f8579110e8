r"""The prefix trie of conversations, by most-significant-digit radix partitioning.

1. Turns (role, text) are numbered by a dictionary, a table of their hashes; texts go no further. A conversation is an array of
   numbers; equal ones become one row, with the number of members and the smallest.
2. Rows start in one bucket. In each round, a bucket of more than LOCAL turns is split by its next digit, the number of its next turn.
   Turns that all its rows share are skipped: they are the common prefix of the least and the greatest row, two aggregates. What
   a split leaves behind is a stretch of nodes without branches; buckets that are small, or hold one row, are local.
3. Local buckets are dealt to tasks, sorted by multikey quicksort, and its recursion gives their nodes. Leaves and saved tokens
   below a stretch are summed over the buckets that have it among their ancestors.

Buckets with many rows (a first turn that a third of all conversations share) stay spread: they are looked up in broadcast tables of
a bounded number of rows (spread_join), and counted where their rows are. Members that end at a node are put in order by ranges
of conv_id, of at most RANGE ids, and hashed range by range, so no group of them is held at once.

Defined results: turns are in the order of (turn, hash), null turns first; a null role or text is empty; rows without conv_id belong
to no conversation; repeated rows are turns of their own; a conversation is one row however many turns it has; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, staged, table, workspace

FAMILY = 100  # conversations whose first one gives the others their beginning
HEADS = 6  # more than the turns that are taken from it
LOCAL = 512  # turns of a bucket that a task finishes
RANGE = 4096  # ids
SHARE = 4096  # keys with more than one such part of all rows are looked up apart
EMPTY = hashlib.sha256().hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# Conversations.


def sequences(turns: DataFrame, path: str) -> DataFrame:
    """conv_id, ids and sizes (code points) of each conversation's turns, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.length(role).cast("string"), F.lit(" "), role, text), 256)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("turn_key"), F.char_length(text).cast("long").alias("size"))
    rows = staged(rows, f"{path}/turns")
    counts = rows.groupBy("turn_key").agg(F.count(F.lit(1)).alias("uses"))
    dictionary = staged(counts.withColumn("id", F.monotonically_increasing_id()).withColumn("deal", F.xxhash64("turn_key")), f"{path}/dictionary")
    limit = max(64, rows.count() // SHARE)
    rows = spread_join(rows.withColumn("deal", F.xxhash64("turn_key")), dictionary, ["turn_key", "deal"], "uses", limit, ["conv_id", "turn"])
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "turn_key", "id", "size"))).alias("t"))
    return staged(held.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")), f"{path}/sequences")


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations that begin as the first one of their family does, for as many turns as a hash says."""
    first = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first")
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.slice("ids", 1, HEADS - 1).alias("head_ids"), F.slice("sizes", 1, HEADS - 1).alias("head_sizes"))
    met = convs.withColumn("first", first).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")).join(heads.hint("merge"), "first", "left")

    def joined(own: str, head: str) -> Column:
        start = F.slice(F.coalesce(head, F.array().cast("array<long>")), F.lit(1), F.col("h"))
        return F.concat(start, F.slice(own, F.col("h") + 1, F.size(own)))

    return met.select("conv_id", joined("ids", "head_ids").alias("ids"), joined("sizes", "head_sizes").alias("sizes"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ends, span, text), sorted: the hash of each one's texts, with commas between."""
    at, so_far = None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([at], pa.int64()), pa.array([so_far.hexdigest()], pa.string())], names=["ends", "ends_sha256"])

    for batch in batches:
        for ends, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if ends == at:
                so_far.update(b",")
            else:
                if so_far:
                    yield done()
                at, so_far = ends, hashlib.sha256()
            so_far.update(text.as_py().encode())
    if so_far:
        yield done()


def classes(convs: DataFrame, path: str) -> DataFrame:
    """Different conversations: conv (the smallest member), n (members), ids, sizes, ends_sha256."""
    convs = staged(convs, f"{path}/rebuilt")
    same = convs.groupBy("ids").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.min("sizes").alias("sizes"))  # sizes follow from ids
    same = staged(same.withColumn("deal", F.xxhash64("ids")), f"{path}/same")
    limit = max(64, convs.count() // SHARE)
    named = spread_join(convs.select("conv_id", "ids", F.xxhash64("ids").alias("deal")), same.select("ids", "deal", "n", F.col("conv").alias("ends")), ["ids", "deal"], "n", limit, ["conv_id"])
    ranges = named.groupBy("ends", F.floor(F.col("conv_id") / RANGE).alias("span")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("text"))
    digests = ranges.repartition("ends").sortWithinPartitions("ends", "span").mapInArrow(_digests, "ends long, ends_sha256 string")
    return staged(same.join(digests.withColumnRenamed("ends", "conv"), "conv").select("conv", "n", "ids", "sizes", "ends_sha256"), f"{path}/classes")


# Buckets.


def _common(a: str, b: str) -> Column:
    """How many first elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(F.col(a), i) != F.get(F.col(b), i)))
    return F.element_at(differ, 1)


def split(rows: DataFrame, path: str, local: int) -> tuple[DataFrame, DataFrame]:
    """Local buckets' rows, and the buckets that were split.

    Local rows: bucket, depth of the bucket's first node, parent (the smallest member above it), path (buckets split on the way), conv, n, ids,
    sizes, ends_sha256. Buckets split: bucket, path (with itself), depth, common (the depth of its last node), conv, n, parent, sizes, children.
    """
    none = F.array().cast("array<long>")
    rows = rows.select(F.lit(-1).cast("long").alias("above"), F.lit(-1).cast("long").alias("digit"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), none.alias("path"), "conv", "n", "ids", "sizes", "ends_sha256")
    finished, opened = [], []
    limit = max(64, rows.count() // SHARE)
    step = used = 0  # numbers of buckets
    while True:
        here = f"{path}/split-{step}"
        stats = rows.groupBy("above", "digit").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("members"), F.sum(F.size("ids") - F.col("depth")).alias("turns"), F.min("conv").alias("least"), F.min(F.struct("ids", "sizes")).alias("low"), F.max("ids").alias("high"))
        stats = stats.withColumn("bucket", F.monotonically_increasing_id() + F.lit(used)).withColumn("first", F.col("low.ids")).withColumn("open", (F.col("rows") > 1) & (F.col("turns") > local))
        stats = staged(stats.withColumn("common", F.when(F.col("open"), _common("first", "high"))).select("above", "digit", "bucket", "rows", "members", "least", "open", "common", F.col("low.sizes").alias("low_sizes")), f"{here}/stats")
        met = staged(spread_join(rows, stats.drop("low_sizes"), ["above", "digit"], "rows", limit, ["conv"]), f"{here}/rows")
        done = met.where(~F.col("open")).select("bucket", "depth", "parent", "path", "conv", "n", "ids", "sizes", "ends_sha256")
        finished.append(done)
        largest, more = stats.agg(F.max("bucket"), F.max("open")).first()
        if not more:
            break
        used = largest + 1
        on = met.where("open").withColumn("path", F.concat("path", F.array("bucket")))
        # what all rows of a bucket share comes from any of them; the row that ends with the stretch gives its hash
        ends = F.max(F.when(F.size("ids") == F.col("common"), F.col("ends_sha256"))).alias("ends_sha256")
        shared = on.groupBy("bucket").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("path").alias("path"), ends, F.count_distinct(F.get("ids", F.col("common"))).alias("children"))
        known = stats.where("open").select("bucket", "common", F.col("least").alias("conv"), F.col("members").alias("n"), F.col("low_sizes").alias("sizes"))
        opened.append(staged(shared.join(known, "bucket"), f"{here}/opened"))
        rows = on.where(F.size("ids") > F.col("common")).select(F.col("bucket").alias("above"), F.get("ids", F.col("common")).alias("digit"), (F.col("common") + 1).alias("depth"), F.col("least").alias("parent"), "path", "conv", "n", "ids", "sizes", "ends_sha256")
        step += 1
    every = finished[0]
    for part in finished[1:]:
        every = every.union(part)
    wide = rows.sparkSession.createDataFrame([], "bucket long, depth int, parent long, path array<long>, ends_sha256 string, children long, common int, conv long, n long, sizes array<long>")
    for part in opened:
        wide = wide.union(part.select(wide.columns))
    return every, wide


# A bucket's nodes.


class Node:
    __slots__ = ("above", "children", "conv", "depth", "ends", "leaves", "n", "saved", "size")

    def __init__(self, above: int, depth: int, size: int):
        self.above, self.depth, self.size = above, depth, size
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, EMPTY


def nodes_of(rows: list[tuple], depth: int) -> list[Node]:
    """The nodes of rows (conv, n, ids, sizes, ends) that share their first turns up to a depth; parents stand before children.

    Multikey quicksort with a stack of its own: a part whose turns at a depth are equal makes the node below.
    """
    made = [Node(-1, depth, rows[0][3][depth - 1] if depth else 0)]
    todo = [(rows, depth, 0)]  # rows that share a number of turns, which lead to a node
    while todo:
        some, d, at = todo.pop()
        on = []
        for r in some:
            if len(r[2]) == d:  # rows differ, so only one ends here
                node = made[at]
                node.conv, node.n, node.ends = r[0], r[1], r[4]
            else:
                on.append(r)
        parts = [on]
        while parts:
            part = parts.pop()
            if not part:
                continue
            pivot = part[len(part) // 2][2][d]
            parts.append([r for r in part if r[2][d] < pivot])
            parts.append([r for r in part if r[2][d] > pivot])
            same = [r for r in part if r[2][d] == pivot]
            made.append(Node(at, d + 1, same[0][3][d]))
            todo.append((same, d + 1, len(made) - 1))
    for node in reversed(made):
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.size if node.depth else 0
        if node.above >= 0:
            up = made[node.above]
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
            up.n, up.children, up.leaves, up.saved = up.n + node.n, up.children + 1, up.leaves + node.leaves, up.saved + node.saved
    return made


OUT = [("bucket", pa.int64()), ("path", pa.list_(pa.int64())), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of local buckets, rows of which stand together; path is null but for a bucket's first node."""
    at, held, about = None, [], None

    def nodes() -> Iterator[pa.RecordBatch]:
        depth, parent, path = about
        made, rows = nodes_of(held, depth), []
        for i, x in enumerate(made):
            rows.append((at, None if i else path, x.conv, x.depth, made[x.above].conv if i else parent, x.n, x.children, x.leaves, x.saved, x.ends))
        for a in range(0, len(rows), 8192):
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows[a : a + 8192], strict=True), OUT, strict=True)], names=[n for n, _ in OUT])

    for batch in batches:
        for bucket, depth, parent, path, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != at:
                if held:
                    yield from nodes()
                at, held, about = bucket, [], (depth, parent, path)
            held.append(tuple(row))
    if held:
        yield from nodes()


def _stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of buckets that were split: a stretch each, of which all but the last have one child."""
    for batch in batches:
        for r in batch.to_pylist():
            rows, saved = [], r["saved"]
            for d in range(r["depth"], r["common"] + 1):
                last = d == r["common"]
                rows.append((r["bucket"], None, r["conv"], d, r["parent"] if d == r["depth"] else r["conv"], r["n"], r["children"] if last else 1, r["leaves"], saved, (r["ends_sha256"] if last else None) or EMPTY))
                saved -= (r["n"] - 1) * r["sizes"][d - 1] if d else 0
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), OUT, strict=True)], names=[n for n, _ in OUT])


def trie(convs: DataFrame, path: str | None = None, local: int = LOCAL) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, ids, sizes); see NODES."""
    path = path or workspace(convs.sparkSession, "trie")
    done, opened = split(classes(convs, path), path, local)
    schema = "bucket long, path array<long>, " + NODES
    dealt = done.repartition(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")
    inner = staged(dealt.mapInArrow(_finish, schema), f"{path}/local")
    own = F.aggregate(F.slice("sizes", F.greatest(F.col("depth"), F.lit(1)), F.col("common") - F.greatest(F.col("depth"), F.lit(1)) + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    parts = opened.select(F.explode("path").alias("bucket"), F.lit(0).cast("long").alias("leaves"), ((F.col("n") - 1) * own).alias("saved"))
    parts = parts.union(inner.where("path is not null").select(F.explode("path").alias("bucket"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    sums = parts.groupBy("bucket").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    outer = opened.join(sums, "bucket").mapInArrow(_stretched, schema)
    return inner.union(outer).drop("bucket", "path")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "trie")
    return trie(rebuilt(sequences(table(spark, sf_dir, "conversations"), path)), path)


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda c, b:
  list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
), convs AS MATERIALIZED (
  SELECT conv_id, conv_id::VARCHAR AS s, list(struct_pack(k := sha256(length(r) || ' ' || r || t), n := length(t)) ORDER BY turn NULLS FIRST, sha256(length(r) || ' ' || r || t)) AS seq FROM turns GROUP BY conv_id
), hashed AS (
  SELECT conv_id, seq, ({_CRC} % 6)::BIGINT AS h FROM convs
), rebuilt AS MATERIALIZED (
  SELECT a.conv_id, list_concat(coalesce(b.seq, [])[1:a.h], a.seq[a.h + 1:]) AS seq FROM hashed a LEFT JOIN hashed b ON b.conv_id = a.conv_id - a.conv_id % 100
), prefixes AS (
  SELECT conv_id, len(seq) AS size, unnest(range(len(seq) + 1)) AS depth, seq FROM rebuilt
), keyed AS MATERIALIZED (
  SELECT conv_id, size, depth, md5(array_to_string(list_transform(seq[1:depth], lambda x: x.k), ',')) AS g, coalesce(seq[depth].n, 0) AS n FROM prefixes
), nodes AS MATERIALIZED (
  SELECT g, depth, min(conv_id) AS conv, count(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE any_value(n) END AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM keyed GROUP BY g, depth
), above AS MATERIALIZED (
  SELECT k.g, k.depth, u.g AS up, u.depth AS up_depth FROM (SELECT g, depth, min(conv_id) AS c FROM keyed GROUP BY g, depth) k JOIN keyed u ON u.conv_id = k.c AND u.depth <= k.depth
), children AS (
  SELECT up AS g, up_depth AS depth, count(*) AS n_children FROM above WHERE up_depth = depth - 1 GROUP BY ALL
), below AS (
  SELECT a.up AS g, a.up_depth AS depth, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.n) AS saved
  FROM above a JOIN nodes x ON x.g = a.g AND x.depth = a.depth LEFT JOIN children c ON c.g = a.g AND c.depth = a.depth GROUP BY ALL
)
SELECT n.conv AS conv_id, n.depth, p.conv AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.g = n.g AND b.depth = n.depth LEFT JOIN children c ON c.g = n.g AND c.depth = n.depth
LEFT JOIN above a ON a.g = n.g AND a.depth = n.depth AND a.up_depth = n.depth - 1 LEFT JOIN nodes p ON p.g = a.up AND p.depth = a.up_depth
"""
