import random
import re
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import near_dedup
from foliant.llm.components import components


def sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute(rows, percent=85):
    made = sets(rows)
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for i, a in made:
        for j, b in made:
            if None not in (i, j) and i < j and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, s in made), key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near_dedup.near_groups(df, percent=85).collect()), key=repr) == brute(rows)


def near_rows(n=120, words=60, most=9):
    """Copies of one text that differ in different places, so that some link to the first one and some only to others."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randrange(most)):
            t[min(words - 1, int(rng.expovariate(0.2)))] = f"x{rng.randrange(3)}"
        rows.append((1000 - i, " ".join(t)))
    return rows


def test_real(spark, sf):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_awkward_rows(spark, awkward, empty):
    check(spark, [(r["doc_id"], r["text"]) for r in awkward.collect()])
    kept = near_dedup.drop_near_copies(awkward)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 8, 9, 10, None}
    assert near_dedup.near_groups(empty).count() == 0


def test_groups_of_near_copies(spark):
    check(spark, near_rows())


@pytest.mark.parametrize("part", [256, 16])
def test_blocks_alone_find_all_links(spark, monkeypatch, part):
    monkeypatch.setattr(near_dedup, "STARS", 0)
    monkeypatch.setattr(near_dedup, "PART", part)
    check(spark, near_rows(80))


def test_rows_that_share_a_doc_id_pool_their_links(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, a), (7, a), (7, b), (9, b), (5, "other words")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 5), (7, 3), (7, 3), (9, 3)]


def test_sketches():
    rng = np.random.default_rng(1)
    for size in (5, 64, 65, 400, 3000):
        errors = []
        for _ in range(40):
            items = np.unique(rng.integers(0, 2**63, size + size // 8).astype(np.uint64))
            a, b = items[:size], items[-size:]
            ra, rb = near_dedup.registers(a), near_dedup.registers(b)
            assert (near_dedup.registers(items) == np.maximum(ra, rb)).all()  # sketches merge
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(near_dedup.likely(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0] - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_components(spark, tmp_path):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 540)]
    root = list(range(600))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/c").collect()
    nodes = defaultdict(int, {r["node"]: r["component"] for r in got})
    assert {n for e in edges for n in e if top(n) != n} == set(nodes)
    assert all(nodes[n] == top(n) for n in nodes)


@pytest.mark.parametrize("stars", [near_dedup.STARS, 0])
def test_another_threshold(spark, sf, monkeypatch, stars):
    """Groups and dropped copies at 0.8 against a brute-force version, through hubs and through blocks alone."""
    monkeypatch.setattr(near_dedup, "STARS", stars)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10**6 + i, t) for i, t in near_rows(60)]
    made = [x for x in sets(rows) if x[1]]
    root = {i: i for i, _ in made}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in made:
        for j, b in made:
            if i < j and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, docs.schema).repartition(3)
    want = {i: top(i) for i in root}
    assert any(r[2] != want.get(r[0], r[0]) for r in brute(rows))  # some are linked at 0.8 only
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df, percent=80).collect() if r["n_shingles"]} == want
    if stars:
        assert {r["doc_id"] for r in near_dedup.drop_near_copies(df, percent=80).collect()} == {i for i, _ in rows if want.get(i, i) == i}


def test_clashing_names(clashing):
    kept = near_dedup.drop_near_copies(clashing)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 8, 9, 10, None}
