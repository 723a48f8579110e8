from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import mixing
from foliant.llm.common import workspace


def filled(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Targets by resharing until none is above its limit."""
    names = sorted(sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"1a": 100, "1b": 10, "1c": 1, "2": 5}, {"1a": 1}, {"1a": 0, "1b": 0}, {"1a": 0, "1b": 7}, {f"1{i:03d}": (i * 7919) % 101 for i in range(40)}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long")).collect()
    want = filled(sizes)
    assert {r["src"]: r["target"] for r in got} == pytest.approx(want)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.query(spark, sf).collect()
    assert len(rows) == docs.count() and sorted(rows) == sorted(mixing.query(spark, sf).collect())
    taken, source = defaultdict(int), {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source[r["doc_id"]]] += r["taken"]
    largest = max(r["size"] for r in rows)
    for r in rows:
        assert abs(taken[source[r["doc_id"]]] - r["target"]) <= largest / 2 + 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["taken"] // r["size"] for r in rows if r["size"])


def test_order_follows_the_schedules(spark):
    """Sources with falling weights are spent earlier than those with growing weights."""
    docs = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    order = [r["source"] for r in mixing.mix(docs, weights=(1, 1, 1)).collect()]
    share = lambda part, s: part.count(s) / len(part)
    first, last = order[: len(order) // 4], order[-len(order) // 4 :]
    assert share(first, "a") > share(last, "a") + 0.1 and share(first, "c") < share(last, "c") - 0.1


def test_awkward_rows(spark, awkward, empty):
    p = mixing.plan(awkward, workspace(spark, "test")).collect()
    assert sum(r["n"] for r in p) == awkward.count()
    assert {r["src"] for r in p} == {"1a", "1b", "1c", "2"}
    assert mixing.mix(awkward).columns == awkward.columns
    assert mixing.mix(empty).count() == 0
    none = awkward.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix(none).count() == 0 and {r["target"] for r in mixing.plan(none, workspace(spark, "test")).collect()} == {0.0}


def test_a_source_may_be_taken_more_than_twice(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 20 else "b") for i in range(220)], "doc_id long, text string, source string")
    rows = mixing.plan(docs, workspace(spark, "test"), most=3.5).collect()
    taken = {s: sum(r["size"] * len(r["positions"]) for r in rows if r["src"] == s) for s in ("1a", "1b")}
    for r in rows:
        assert abs(taken[r["src"]] - r["target"]) <= 5
    assert {len(r["positions"]) for r in rows if r["src"] == "1a"} == {3, 4}


def test_clashing_names(clashing):
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns
    want = {(r["doc_id"], r["text"]): tuple(r) for r in clashing.collect()}
    got = mixed.collect()
    assert got and all(tuple(r) == want[r["doc_id"], r["text"]] for r in got)
