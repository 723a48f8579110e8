"""Exact k-means of integer vectors by balls.

A cluster is a ball: its centroid and the farthest of its members. Another centroid can be the nearest to some member only if half
its distance lies within that radius, so each ball has a list of neighbours, sorted by distance. Half the distance to the first of
them bounds the stable core, whose members stay without a comparison; from there on, half the distances to the others cut the ball
into annuli, and a member of the n-th annulus is compared with the first n neighbours only. All of this is tested on squared
distances of integers (4 * d(x, own) against d(own, other)), ties included, so the result is that of comparing everything.

Balls are formed anew in each Arrow batch, whose radii are no larger than those of whole clusters, so their lists are no longer.
Before the first round all vectors are in ball 0. Each round reads the table that the one before wrote (vector, cluster), adds up the
members' components by cluster where they are, and brings the sums to the driver: at most K * DIMENSIONS rows, whatever the input.

Defined results: a vector is kept if it has exactly DIMENSIONS components, none null, non-finite, or so large that squared distances
might not fit a long (LARGEST after scaling); rows without vec_id hash as an empty number; rows that share a vec_id are vectors of
their own; centroids that start alike are told apart by their numbers; fewer kept vectors than K give as many centroids; an empty
table, or one without kept vectors, gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, spread, staged, table, workspace

DIMENSIONS = 64
SCALE = 64
K = 16
ROUNDS = 3
LARGEST = 1 << 27  # 64 * (2 * 2**27)**2 = 2**62
MOST = 4096  # vectors that are compared at a time

Balls = np.ndarray  # K x DIMENSIONS integers


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, point (integers) of the vectors that are kept."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < F.lit(LARGEST)))
    return vectors.where((F.size("embedding") == DIMENSIONS) & fits).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<long>").alias("point"))


def first_centroids(points: DataFrame, k: int = K) -> Balls:
    """The vectors whose ids have the smallest hashes: k rows."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.select(name.alias("name"), "point").orderBy("name", "point").limit(k).collect()
    return np.array([r["point"] for r in rows], np.int64).reshape(len(rows), DIMENSIONS)


def between(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances."""
    apart = points - centre
    return np.einsum("ij,ij->i", apart, apart)


def assigned(points: np.ndarray, guess: np.ndarray, centroids: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each point and its squared distance, from the balls that points are in; how many distances were computed."""
    cluster, distance = guess.copy(), np.empty(len(points), np.int64)
    asked = 0
    for own in np.unique(guess).tolist():
        members = np.flatnonzero(guess == own)
        mine = between(points[members], centroids[own])
        asked += len(members)
        apart = between(centroids, centroids[own])
        near = np.flatnonzero(apart <= 4 * mine.max())  # neighbours of the ball, and itself
        near = near[near != own]
        near = near[np.argsort(apart[near], kind="stable")]
        annulus = np.searchsorted(apart[near], 4 * mine, side="right")  # 0: the stable core
        best, least = np.full(len(members), own), mine.copy()
        for n, other in enumerate(near.tolist()):
            outer = np.flatnonzero(annulus > n)
            d = between(points[members[outer]], centroids[other])
            asked += len(outer)
            better = (d < least[outer]) | ((d == least[outer]) & (other < best[outer]))
            best[outer[better]], least[outer[better]] = other, d[better]
        cluster[members], distance[members] = best, least
    return cluster, distance, asked


def _round(batches: Iterator[pa.RecordBatch], centroids: Balls) -> Iterator[pa.RecordBatch]:
    """vec_id, point, cluster, distance of rows that have vec_id, point, cluster."""
    for batch in batches:
        for at in range(0, batch.num_rows, MOST):
            part = batch.slice(at, MOST)
            lists = part.column(1)
            points = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            cluster, distance, _ = assigned(points, part.column(2).to_numpy(), centroids)
            yield pa.record_batch([part.column(0), lists, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "point", "cluster", "distance"])


def _sums(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (cluster, point): members and sums of components by cluster."""
    n, total = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64)
    for batch in batches:
        cluster = batch.column(0).to_numpy()
        points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(cluster), -1)
        for c in np.unique(cluster).tolist():
            n[c] += (cluster == c).sum()
            total[c] += points[cluster == c].sum(0)
    some = np.flatnonzero(n)
    yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])


def moved(rows: DataFrame, centroids: Balls) -> Balls:
    """The floors of the means of clusters; empty ones stay. Sums are made where rows are: K * DIMENSIONS rows come to the driver."""
    k = len(centroids)
    parts = rows.select("cluster", "point").mapInArrow(lambda batches: _sums(batches, k), "cluster int, n long, total array<long>")
    whole = parts.select("cluster", "n", F.posexplode("total").alias("axis", "x")).groupBy("cluster", "axis").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    new = centroids.copy()
    for r in whole.collect():
        new[r["cluster"], r["axis"]] = r["x"] // r["n"]
    return new


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, path: str | None = None) -> tuple[DataFrame, Balls]:
    """vec_id, point, cluster, distance (squared) of the vectors kept after so many rounds and a last assignment; the centroids."""
    path = path or workspace(vectors.sparkSession, "balls")
    rows = staged(spread(integers(vectors)).withColumn("cluster", F.lit(0)), f"{path}/points")
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return rows.select("vec_id", "point", "cluster", F.lit(0).cast("long").alias("distance")), centroids
    before = f"{path}/points"
    for i in range(rounds + 1):
        # an array as a default argument: the function is pickled before the next round changes it
        after = rows.select("vec_id", "point", "cluster").mapInArrow(lambda batches, c=centroids: _round(batches, c), "vec_id long, point array<long>, cluster int, distance long")
        rows = staged(after, f"{path}/{i}")
        discard(before)
        before = f"{path}/{i}"
        if i < rounds:
            centroids = moved(rows, centroids)
    return rows, centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clusters(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # K rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(i, sums.get(i, 0), sum(sums.values()), name) for i, name in enumerate(names)]
    ends = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """One common table expression a step."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (p[i] - c[i]) * (p[i] - c[i])))"
    steps = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS p FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), p) - 1 AS k, p AS c FROM v QUALIFY k < 16)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT vec_id, p, k, {far} AS d FROM v CROSS JOIN c{i})")
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, p, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if i < ROUNDS:
            means = f"SELECT k, axis, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT k, unnest(p) AS x, unnest(range(1, 65)) AS axis FROM a{i}) GROUP BY k, axis"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(list(x ORDER BY axis) FILTER (x IS NOT NULL), any_value(c)) AS c FROM c{i} LEFT JOIN ({means}) USING (k) GROUP BY k)")
    last = ROUNDS
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, a.k::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,\n"
        f"  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c ON a.k = c.k"
    )


ORACLE = _oracle()
