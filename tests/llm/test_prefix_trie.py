"""The trie against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """conv_id to its turns (role, text), of rows whose turns have no ties."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(first, [])[:h] + own[h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    below = defaultdict(lambda: [0, 0, 0])  # children, leaves, saved
    for node in sorted(members, key=len, reverse=True):
        x = below[node]
        x[1] = x[1] or 1
        x[2] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        if node:
            up = below[node[:-1]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + x[1], up[2] + x[2]
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), *below[p], digest(p)) for p, m in members.items()), key=repr)


def result(df, **kw):
    path = prefix_trie.workspace(df.sparkSession, "trie")
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df, path)), path, **kw)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def made(n, seed):
    """Families that share beginnings, copies of one conversation, one that is long, and gaps in numbers."""
    rnd = random.Random(seed)
    texts = [f"turn {i} é" for i in range(6)]
    rows = []
    for c in rnd.sample(range(-150, 450), n):
        hot = rnd.random() < 0.3
        for t in range(9 if hot else rnd.randint(1, 7)):
            rows.append((c, t, "user" if t % 2 else "assistant", texts[0] if hot else rnd.choice(texts)))
    return rows + [(9001, t, "user", f"long {t}") for t in range(300)] + [(9002, t, "user", f"long {t}") for t in range(200)]


@pytest.mark.parametrize("local", [prefix_trie.LOCAL, 100, 8])
def test_equals_plain(spark, local):
    rows = made(300, 2)
    df = spark.createDataFrame(rows, TURNS).orderBy(F.rand(3)).repartition(4)
    assert result(df, local=local) == plain(rebuilt(rows))


def test_nodes_of_deep_rows():
    deep = [(1, 2, list(range(5000)), [1] * 5000, "a"), (0, 1, list(range(3000)), [1] * 3000, "b")]
    nodes = prefix_trie.nodes_of(deep, 0)
    assert len(nodes) == 5001 and nodes[0].n == 3 and nodes[0].conv == 0 and nodes[0].leaves == 1 and nodes[0].saved == 3000 * 2 + 2000


def test_awkward_turns(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", ""), (1, 1, "user", ""), (1, None, "", None), (2, 5, "user", "x" * 50000), (3, 5, "user", "x" * 50000),
        (None, 1, "user", "lost"), (None, 2, "user", "lost"), (105, 0, "a", "b"), (106, 0, "a", "b"), (-5, 0, "ab", ""), (-105, 0, "a", "b"), (7, 0, "u", "🙂"), (7, 1, "u", "🙂🙂"),
    ]
    df = spark.createDataFrame([(*r, "mine", 1, [2]) for r in rows], TURNS + ", ids string, n int, path array<long>").repartition(3)
    for local in (1, prefix_trie.LOCAL):
        assert result(df, local=local) == plain(rebuilt(rows))
    assert result(df.where("false")) == []
    twice = [(4, 1, "u", "same"), (4, 1, "u", "same"), (4, 2, "u", "end")]
    assert result(spark.createDataFrame(twice, TURNS)) == plain(rebuilt(twice))
    turnless = {c for c, t in rebuilt([(c, 0, "u", "t") for c in range(101, 160)]).items() if not t}
    assert turnless  # which are members of the root only
    assert result(spark.createDataFrame([(c, 0, "u", "t") for c in range(101, 160)], TURNS)) == plain(rebuilt([(c, 0, "u", "t") for c in range(101, 160)]))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.query(spark, sf)
    assert got.columns == [c.split()[0] for c in prefix_trie.NODES.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rebuilt(rows))
