"""Clusters by balls against comparing every vector with every centroid."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import balls, catalog


def plain(rows, k=balls.K, rounds=balls.ROUNDS):
    """vec_id, cluster, distance by id; the centroids. rows: vec_id and components."""
    points = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows]
    order = sorted(points, key=lambda p: (hashlib.sha256(f"1:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))
    centroids = [p for _, p in order[:k]]
    far = lambda p, c: sum((x - y) ** 2 for x, y in zip(p, c, strict=True))
    for i in range(rounds + 1):
        got = [min((far(p, c), n) for n, c in enumerate(centroids)) for _, p in points]
        if i < rounds:
            for n in range(len(centroids)):
                held = [p for (_, p), (_, at) in zip(points, got, strict=True) if at == n]
                if held:
                    centroids[n] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(points, got, strict=True)), key=repr), centroids


def result(spark, rows, **kw):
    df = spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None, "mine", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, point int")
    got, centroids = balls.clusters(df.repartition(3), **kw)
    return sorted((tuple(r) for r in got.select("vec_id", "cluster", "distance").collect()), key=repr), centroids.tolist()


@pytest.mark.parametrize("wide", [0.1, 3.0])
def test_equals_comparing_everything(spark, wide):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64)) * wide
    rows = [(i, (centres[i % 20] + rng.normal(size=64) * 0.2).astype(np.float32)) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(300)]  # one very common vector
    assert result(spark, rows) == plain(rows)


def test_ties_go_to_the_smaller_number():
    centroids = np.array([[4, 0], [0, 0], [0, 0], [2, 2]])
    points = np.array([[2, 0], [0, 0], [4, 0], [2, 1]])
    for guess in range(4):
        cluster, distance, _ = balls.assigned(points, np.full(4, guess), centroids)
        assert cluster.tolist() == [0, 1, 0, 3] and distance.tolist() == [4, 0, 0, 1]


def test_the_core_is_not_compared():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (16, 64))
    guess = np.arange(1600) % 16
    points = centroids[guess] + rng.integers(-20, 20, (1600, 64))
    cluster, _, asked = balls.assigned(points, guess, centroids)
    assert (cluster == guess).all() and asked == len(points)  # its own centroid only
    _, _, asked = balls.assigned(points, np.zeros(1600, np.int64), centroids)
    assert asked > len(points)


def test_awkward_vectors(spark):
    good = [1.5] * 64
    rows = [(1, good), (1, good), (1, [-0.01] * 64), (None, [0.0] * 64), (2, None), (3, [1.0] * 63), (4, [1.0] * 65), (5, []), (6, [float("nan"), *good[1:]]), (7, [float("inf"), *good[1:]]), (8, [3e38, *good[1:]])]
    kept = rows[:4]
    assert result(spark, rows) == plain(kept)
    nulls = spark.createDataFrame([(9, [None, *good[1:]])], "vec_id long, embedding array<float>")
    assert balls.clusters(nulls)[0].count() == 0
    assert result(spark, []) == ([], [])
    assert plain(kept, k=2, rounds=1) == result(spark, rows, k=2, rounds=1)


def test_query(spark, sf):
    got = catalog.QUERIES["op12_centroid_clusters"](spark, sf)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want, centroids = plain([(r["vec_id"], r["embedding"]) for r in vectors])
    rows = got.collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in rows), key=repr) == want
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert all(r["centroid_sha256"] == names[r["cluster"]] for r in rows)
    assert {r["inertia"] for r in rows} == {sum(d for *_, d in want)} == {got.select(F.sum("distance")).first()[0]}
