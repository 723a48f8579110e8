import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import exact_dedup
from foliant.llm.common import workspace


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_awkward_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for capacity in (exact_dedup.CAPACITY, 1):
        got = exact_dedup.exact_groups(awkward, capacity=capacity).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 6, 8, 9, 10]


def test_a_bucket_is_in_one_task(spark, sf, tmp_path):
    """While texts of a key are compared; and the registered capacity makes several buckets of a table of this size."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.union(docs.limit(60)).union(docs.where("doc_id % 3 = 0"))
    for capacity in (4, 64):
        index = exact_dedup.ExactIndex(more, f"file://{tmp_path}/{capacity}", capacity, key=lambda t: F.xxhash64(t) - F.xxhash64(t) % 5)
        keys = exact_dedup.led(spark.read.parquet(f"{index.path}/keys"), index.levels)
        tasks = index.owned(keys).withColumn("task", F.spark_partition_id()).groupBy("bucket").agg(F.count_distinct("task").alias("n"), F.count(F.lit(1)).alias("rows"))
        got = tasks.collect()
        assert len(got) > 2 and all(r["n"] == 1 for r in got) and sum(r["rows"] for r in got) > 50
    assert exact_dedup.CAPACITY < 1000


def test_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_real(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = exact_dedup.exact_groups(docs, capacity=16).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_clashing_names(awkward, clashing):
    """Columns whose names the operator uses inside keep their values."""
    kept = exact_dedup.drop_exact_copies(clashing)
    assert kept.columns == clashing.columns
    want = {r["doc_id"]: tuple(r) for r in clashing.collect()}
    got = kept.collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 5, 6, 8, 9, 10] and all(tuple(r) == want[r["doc_id"]] for r in got)


def unsigned(key):
    return key & 0xFFFFFFFFFFFFFFFF


def test_directory(spark, tmp_path):
    """Buckets against a plain extendible hash of the same keys."""
    rng = np.random.default_rng(1)
    keys = [int(k) for k in rng.integers(-(2**63), 2**63, 900)] + [5 + (i << 4) for i in range(40)]  # 40 that differ late only
    df = spark.createDataFrame([(k,) for k in keys], "key long")

    def plain(some, depth, low, capacity):
        if len(some) <= capacity or len(set(some)) == 1:
            return {low: (depth, sorted(some))} if some else {}
        bit = 63 - depth
        halves = [[k for k in some if unsigned(k) >> bit & 1 == x] for x in (0, 1)]
        return plain(halves[0], depth + 1, low, capacity) | plain(halves[1], depth + 1, low | 1 << bit, capacity)

    for capacity in (1, 7, 64, 10**6):
        levels = exact_dedup.directory(df, len(keys), f"file://{tmp_path}/{capacity}", capacity)
        want = plain(keys, 0, 0, capacity)
        got, depths = {}, {}
        for r in exact_dedup.led(df, levels).collect():
            got.setdefault(int(r["bucket"], 16), []).append(r["key"])
        for _, level in levels:
            depths |= {int(r["bucket"], 16): (r["local_depth"], r["n_keys"]) for r in level.where("bucket is not null").collect()}
        assert {b: sorted(ks) for b, ks in got.items()} == {b: ks for b, (_, ks) in want.items()}
        assert depths == {b: (d, len(ks)) for b, (d, ks) in want.items()}
        assert len(levels) > 1 if capacity < 40 else len(levels) == 1 or capacity == 64


def test_index_has_ranges_of_keys(spark, awkward, tmp_path):
    index = exact_dedup.build_index(awkward, f"file://{tmp_path}/i", capacity=2)
    spans = index.groupBy("bucket").agg({"key": "count"}).collect()
    assert len(spans) > 1 and index.where("chain > 0").count() == 0
    rows = sorted(index.select("bucket", "key").collect(), key=lambda r: unsigned(r["key"]))
    assert [r["bucket"] for r in rows] == sorted(r["bucket"] for r in rows)


@pytest.mark.parametrize("key", [lambda c: F.lit(7).cast("long"), lambda c: F.length(c).cast("long"), lambda c: F.shiftleft(F.length(c).cast("long") % 3, 60)])
def test_bytes_decide_where_keys_collide(awkward, clashing, tmp_path, key):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for capacity in (1, 100):
        got = exact_dedup.exact_groups(awkward, capacity=capacity, key=key).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    index = exact_dedup.build_index(awkward, f"file://{tmp_path}/i", key=key)
    assert index.where("chain > 0").count() > 0 and index.groupBy("bucket", "key", "chain").count().where("count > 1").count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(clashing, key=key).collect()) == [1, 2, 3, 5, 6, 8, 9, 10]


def test_the_result_comes_through_the_buckets(awkward):
    """Rows that the directory leads elsewhere find nothing."""
    index = exact_dedup.ExactIndex(awkward, workspace(awkward.sparkSession, "test"))
    right = index.verdicts(index.rows).where("group_size > 1").count()
    index.levels = [(d, level.withColumn("bucket", F.lit("elsewhere"))) for d, level in index.levels]
    assert right == sum(r[2] > 1 for r in brute([(r["doc_id"], r["text"]) for r in awkward.collect()])) > 0
    assert index.verdicts(index.rows).where("group_size > 1").count() == 0


def test_no_python_worker(spark, sf):
    plan = exact_dedup.exact_groups(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
