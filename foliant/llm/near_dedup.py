r"""Near duplicates by SetSketch registers.

A document is the set of its five-word shingles, kept as 64-bit hashes. Each of the M registers of its sketch holds the
smallest of exponentially distributed values that the shingles give it, truncated to an exponent of base B. A
shingle's j-th value is drawn from the j-th of M equal parts of the distribution, and the values are dealt to the
registers in an order of its own, so that the search ends as soon as no later value can be the smallest
anywhere. Equal registers are likely for similar sets, and sketches of parts merge by taking the larger exponent.

1. Documents with the same set form a class; from here on only one document of each class goes on.
2. Bands of registers are hashed: classes that share a band are candidates. Within a band's bucket they aren't paired with
   each other, but with one hub. A pair's similarity is then estimated by maximum likelihood from the counts of
   registers that are smaller, equal and larger, given both sizes; what is far below the threshold goes.
3. Remaining pairs are verified on the full sets. Those of the classes that share a band with another are computed from the whole
   texts once and written; members meet their hub in groups that are salted by size.
4. Verified links give components. Members of a bucket that aren't in one component with all others meet a new hub,
   and at last each other: buckets are cut into blocks by bytes, and a task compares two blocks at a time and returns the links only.
   So every two members of a bucket are compared or already connected, and no link that a shared band shows is lost.

Buckets, hubs and classes of many rows are looked up in broadcast tables of a bounded number of rows (spread_join), so that none
of them needs to be in one task.

The threshold is a parameter, in per cent, and moves the size filters and the cut-offs of the estimates; it is 80 unless another is
asked for. A pair at similarity 0.85 shares none of the 25 bands of 5 registers with probability 4e-7, one at 0.8 with 5e-5.

Defined results: a null text, or one without words, has the empty set and is linked with nothing; fewer words than five are one shingle;
very long texts are sets of all their shingles; rows that share a doc_id are one document, and their links are pooled; rows without
doc_id are linked with nothing, are kept and have no component_id; an empty table gives an empty result; other columns are
never read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, slices, spread, spread_join, staged, table, text_of, workspace
from .components import components

WORDS = 5  # a shingle
SIMILAR, OF = 80, 100  # linked if OF * intersection >= percent * union; SIMILAR unless another percent is asked for
ASKED = 85  # of the registered query
M = 128  # registers, a power of 2
B = 1.001
TOP = 65535  # largest exponent
RATE = 20.0
BANDS, ROWS = 25, 5
STARS = 3  # hubs a bucket has before the rest meets each other
GROUP = 512  # members that meet a copy of their hub
PART = 512  # members of a block
PART_BYTES = 16 << 20  # of their sets
HELD = 2 << 20  # bytes of text whose sets are computed together
SHARE = 4096  # keys with more than one such part of all classes are looked up apart

U = np.uint64
STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)
INVERSE = np.array([pow(x, -1, M) if x % 2 else 0 for x in range(M)], np.int64)
LOG_B = float(np.log(B))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes(dict):
    LIMIT = 100_000  # words in the cache

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


KNOWN = Hashes()


def shingles(text: str) -> np.ndarray:
    """The hashes of the document's shingles, ascending and distinct."""
    words = text.encode().lower().split()  # bytes.lower() changes A-Z only, bytes.split() cuts at ASCII white space
    h = np.fromiter(map(KNOWN.__getitem__, words), U, len(words))
    if not len(h):
        return h
    k = min(WORDS, len(h))
    out = np.zeros(len(h) - k + 1, U)
    for i in range(k):
        out += mixed(h[i : len(h) - k + 1 + i], i) * STEP[i]
    return np.unique(mixed(out, k))


def registers(items: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty: M exponents."""
    first, stride = (items & U(M - 1)).astype(np.int64), ((items >> U(20)) | U(1)).astype(np.int64) & (M - 1)
    if len(items) * M <= 8192:  # all values at once: which one does each register get?
        j = ((np.arange(M) - first[:, None]) * INVERSE[stride][:, None]) & (M - 1)
        low = _values(items[:, None], j).min(0)
    else:
        low = np.full(M, np.inf)
        for j in range(M):
            np.minimum.at(low, (first + j * stride) & (M - 1), _values(items, np.array([j])))
            if j + 1 < M and low.max() <= -np.log1p(-(j + 1) / M) / RATE:
                break  # later values are all larger
    return np.clip(np.floor(1 - np.log(low) / LOG_B), 0, TOP).astype(np.uint16)


def _values(items: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The j-th value of each item: exponential, from the j-th of M equal parts."""
    u = (mixed(items ^ (j.astype(U) * U(0xD1342543DE82EF95)), 7) >> U(11)).astype(np.float64) * 2.0**-53
    return -np.log1p(-np.minimum((j + u) / M, 1 - 2.0**-53)) / RATE


def bands(sketch: np.ndarray) -> np.ndarray:
    """A hash of each band."""
    rows = sketch[: BANDS * ROWS].reshape(BANDS, ROWS).astype(U)
    h = np.arange(BANDS, dtype=U)
    for i in range(ROWS):
        h = mixed(h * STEP[i] + rows[:, i], i)
    return h.view(np.int64)


GRID = np.linspace(0.0, 1.0, 129)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows of a and b) of sets of known sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = M - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = GRID[None] * np.minimum(u / v, v / u)  # no pair is more similar than its sizes
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / LOG_B
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    score = more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def doubt(percent: int) -> float:
    """Six standard errors of the estimate at the threshold, rounded up to hundredths."""
    share = percent / OF
    return float(np.ceil(600 * np.sqrt(share * (1 - share) / M)) / 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR) -> bool:
    """Whether two sets are linked, from all their members."""
    if not len(a) or not len(b):
        return False
    found = np.searchsorted(a, b)
    found[found == len(a)] = 0
    both = int((a[found] == b).sum())
    return OF * both >= percent * (len(a) + len(b) - both)


def print_of(items: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    s = np.array([items.sum(dtype=U), mixed(items, 3).sum(dtype=U) if len(items) else U(0)], U).view(np.int64)
    return int(s[0]), int(s[1])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only(KNOWN)
    for batch in slices(batches, size=HELD):
        n, one, two, sketches, keys = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            items = shingles(text)
            a, b = print_of(items)
            n.append(len(items))
            one.append(a)
            two.append(b)
            if len(items):
                r = registers(items)
                sketches.append(r.tobytes())
                keys.append(bands(r))
            else:
                sketches.append(None)
                keys.append(np.empty(0, np.int64))
        ends = pa.array(np.concatenate([[0], np.cumsum(list(map(len, keys)))]), pa.int32())
        arrays = [pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys), pa.int64()))]
        yield pa.record_batch([batch.column(0), *arrays], names=["doc_id", "n", "f1", "f2", "sketch", "keys"])


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sketch_a, sketch_b, n_a, n_b) whose estimate isn't far below the threshold."""
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, M) for i in (2, 3))
            sizes = [part.column(i).to_numpy().astype(float) for i in (4, 5)]
            keep = pa.array(likely(a, b, *sizes) >= percent / OF - doubt(percent))
            yield pa.record_batch([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep and items of documents: doc, text, f1."""
    only(KNOWN)
    for batch in slices(batches, rows=1024, size=HELD):
        reps, sets = [], []
        for doc, text, f1 in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            items = shingles(text)
            if print_of(items)[0] == f1:  # of rows that share a doc_id, the one that is meant
                reps.append(doc)
                sets.append(items.tobytes())
        yield pa.record_batch([pa.array(reps, pa.int64()), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["rep", "items"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of a hub and its members, the hub first: the links that hold on the full sets."""
    at, held = None, np.empty(0, U)
    for batch in batches:
        a, b = [], []
        for hub, salt, follows, doc, items in zip(*(batch.column(i) for i in range(5)), strict=True):
            hub, salt, doc, items = hub.as_py(), salt.as_py(), doc.as_py(), np.frombuffer(items.as_buffer(), U)
            if not follows.as_py():
                at, held = (hub, salt), items
            elif at == (hub, salt):
                if similar(held, items, percent):
                    a.append(hub)
                    b.append(doc)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, path: str, percent: int, limit: int) -> DataFrame:
    """The pairs (a, b) that are linked: a is a hub, which may have any number of pairs."""
    ends = reps.select("rep", "sketch", "n")
    pairs = staged(pairs, f"{path}/pairs")
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    left = hubs.join(ends.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a")
    right = ends.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    sized = spread_join(pairs.join(right, "b"), left, ["a"], "members", limit, ["a", "b"]).where(OF * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    close = staged(sized.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(lambda batches: _close(batches, percent), "a long, b long"), f"{path}/close")
    sizes = close.groupBy("a").agg(F.count(F.lit(1)).alias("members")).withColumn("parts", F.ceil(F.col("members") / GROUP).cast("int"))
    members = spread_join(close, sizes, ["a"], "members", limit, ["a", "b"])
    members = members.select(F.col("b").alias("rep"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("salt"), F.lit(True).alias("follows"))
    heads = sizes.select(F.col("a").alias("rep"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("follows"))
    roles = members.union(heads).groupBy("rep").agg(F.collect_list(F.struct("hub", "salt", "follows")).alias("roles"))  # BANDS of a member, a group each of a hub
    rows = sets.join(roles, "rep").select("rep", "items", F.explode("roles").alias("role")).select("role.hub", "role.salt", "role.follows", F.col("rep").alias("doc"), "items")
    met = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "follows")
    return staged(met.mapInArrow(lambda batches: _verify(batches, percent), "a long, b long"), f"{path}/links")


def _links_within(rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Links in one block pair of a bucket, from (own, band, doc, comp, sketch, items), without those that components already know.

    A pair that shares several bands is looked at in the bucket of the first one only.
    """
    rows.sort(key=lambda r: r[2])
    root: dict[int, int] = {r[3]: r[3] for r in rows}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    items = [r[5] for r in rows]
    sizes = np.array([len(x) for x in items], np.int64)
    sketches = np.stack([r[4] for r in rows])
    own, mixed_blocks = np.array([r[0] for r in rows]), len({r[0] for r in rows}) > 1
    for k in range(len(rows) - 1):
        least, most = np.minimum(sizes[k], sizes[k + 1 :]), np.maximum(sizes[k], sizes[k + 1 :])
        may = OF * least >= percent * most
        if mixed_blocks:
            may &= own[k + 1 :] != own[k]
        at = np.flatnonzero(may) + k + 1
        same = sketches[at] == sketches[k]
        shared = same[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(2)
        go = (same.sum(1) * OF >= M * (percent - 2 * OF * doubt(percent))) & (shared.argmax(1) == rows[k][1])
        at = at[go]
        if len(at):
            at = at[likely(np.broadcast_to(sketches[k], (len(at), M)), sketches[at], np.full(len(at), float(sizes[k])), sizes[at].astype(float)) >= percent / OF - doubt(percent)]
        for x in at.tolist():
            a, b = top(rows[k][3]), top(rows[x][3])
            if a != b and similar(items[k], items[x], percent):
                root[max(a, b)] = min(a, b)
                yield rows[k][2], rows[x][2]


def _meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    at, held = None, []

    def links() -> pa.RecordBatch:
        found = list(_links_within(held, percent)) if len(held) > 1 else []
        return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for key, i, j, *rest, sketch, items in zip(*(batch.column(n) for n in range(9)), strict=True):
            place = key.as_py(), i.as_py(), j.as_py()
            if place != at:
                yield links()
                at, held = place, []
            # copied, as a batch is given back
            held.append((*(x.as_py() for x in rest), np.frombuffer(sketch.as_py(), np.uint16), np.frombuffer(items.as_py(), U)))
    yield links()


def met_in_blocks(opened: DataFrame, reps: DataFrame, sets: DataFrame, path: str, percent: int, limit: int) -> DataFrame:
    """Links between the members of open buckets. Buckets are cut into blocks, and each task holds two of them at a time."""
    opened = opened.select("key", "band", "rep", "comp")
    sized = opened.join(reps.select("rep", "n"), "rep")
    sizes = sized.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("all"))
    parts = F.greatest(F.ceil(F.col("members") / PART), F.ceil(F.col("all") * 8 / PART_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("own")
    placed = spread_join(opened, sizes.select("key", "members", parts.alias("parts")), ["key"], "members", limit, ["key", "rep"])
    placed = placed.groupBy("rep", "comp").agg(F.collect_list(F.struct("key", "band", "parts", own)).alias("roles"))  # BANDS roles at most
    rows = sets.join(placed, "rep").join(reps.select("rep", "sketch"), "rep").select("rep", "comp", "sketch", "items", F.explode("roles").alias("r"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("r.parts") - 1)).alias("other"))
    rows = rows.select("r.key", F.least("r.own", "other").alias("i"), F.greatest("r.own", "other").alias("j"), "r.own", "r.band", F.col("rep").alias("doc"), "comp", "sketch", "items")
    met = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return staged(met.mapInArrow(lambda batches: _meet(batches, percent), "a long, b long"), f"{path}/links")


def _opened(members: DataFrame, limit: int) -> DataFrame:
    """The members of buckets that hold more than one component, with their hub."""
    first = F.min(F.struct("rep", "comp")).alias("first")
    hubs = members.groupBy("key").agg(first, F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("held")).where("x <> y")
    hubs = hubs.select("key", "held", F.col("first.rep").alias("hub"), F.col("first.comp").alias("hub_comp"))
    return spread_join(members, hubs, ["key"], "held", limit, ["key", "rep"]).where("hub is not null")


def near_groups(docs: DataFrame, path: str | None = None, percent: int = SIMILAR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Sets are linked from this similarity on."""
    spark = docs.sparkSession
    path = path or workspace(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = staged(spread(docs).mapInArrow(_sketch, "doc_id long, n long, f1 long, f2 long, sketch binary, keys array<long>"), f"{path}/rows")
    full = rows.where("n > 0 and doc_id is not null")
    first = full.groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "sketch", "keys")).alias("one"), F.count(F.lit(1)).alias("size"))
    reps = staged(first.select(F.col("one.doc_id").alias("rep"), "n", "f1", "f2", "size", F.col("one.sketch").alias("sketch"), F.col("one.keys").alias("keys")), f"{path}/reps")
    limit = max(64, reps.count() // SHARE)  # each class is in BANDS buckets, so at most BANDS * SHARE keys have more classes

    # rows that share a doc_id but not their texts
    classes = reps.select("n", "f1", "f2", "rep")
    twice = full.groupBy("doc_id").agg(F.min("f1").alias("x"), F.max("f1").alias("y")).where("x <> y").select("doc_id")
    pooled = full.join(twice, "doc_id").join(classes, ["n", "f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = staged(pooled, f"{path}/pooled")

    members = reps.select("rep", F.posexplode("keys").alias("band", "key")).withColumn("comp", F.col("rep"))
    opened = staged(_opened(members, limit), f"{path}/opened")
    wanted = opened.select("rep").distinct().join(reps.select("rep", "f1"), "rep")
    texts = docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("rep", "text", "f1")
    sets = staged(texts.mapInArrow(_sets, "rep long, items binary"), f"{path}/sets")
    for step in range(STARS + 1):
        here = f"{path}/{step}"
        if step < STARS:  # every member meets its bucket's hub, unless both are connected
            pairs = opened.where("comp <> hub_comp").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
            links = links.union(verified(pairs, reps, sets, here, percent, limit))
        else:
            links = links.union(met_in_blocks(opened, reps, sets, here, percent, limit))
        stars = components(links, f"{here}/components")
        links = stars.select(F.col("node").alias("a"), F.col("component").alias("b"))  # which say the same
        if step == STARS:
            break
        # the hub has met all others of its bucket; those that are still open go on without it
        rest = opened.where("rep <> hub").select("key", "band", "rep")
        named = stars.select(F.col("node").alias("rep"), F.col("component").alias("comp_"))
        members = rest.join(named, "rep", "left").select("rep", "band", "key", F.coalesce("comp_", "rep").alias("comp"))
        opened = staged(_opened(members, limit), f"{here}/opened")
        if not opened.head(1):
            break
    named = stars.select(F.col("node").alias("rep"), F.col("component").alias("comp_"))
    comps = reps.join(named, "rep", "left").select("n", "f1", "f2", "size", "rep", F.coalesce("comp_", "rep").alias("component"))
    comps = comps.where("size > 1 or component <> rep").select("n", "f1", "f2", "size", "component")
    one = rows.select("doc_id", "n", "f1", "f2")
    plain = "n > 0 and doc_id is not null"
    some = spread_join(one.where(plain), comps, ["n", "f1", "f2"], "size", limit, ["doc_id"]).select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    out = some.union(one.where(f"not ({plain})").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, path: str | None = None, percent: int = SIMILAR) -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    gone = near_groups(docs, path, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_of_a_group")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_of_a_group"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), percent=ASKED)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), items AS (
  SELECT DISTINCT doc_id, md5(unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * common >= 85 * (s.n + t.n - common)
), either AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reached AS (
  SELECT doc_id AS node, doc_id AS start FROM documents UNION SELECT y, start FROM reached JOIN either ON x = node
), least AS (
  SELECT node, min(start) AS component_id FROM reached GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN least ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
