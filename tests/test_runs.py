"""Runs, versions and leases: dictionary without postings, tiers, racing and killed writers, lookups of words and names."""

import fnmatch
import math
import os
import random
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.operators import lookup, members
from foliant.operators.index import Index, IndexInUse
from foliant.operators.versions import Leases, Numbered, Store

TEXTS = "file_id long, name string, kind string, text string"
ROOT = Path(__file__).resolve().parent.parent


def batch(spark, ids, words="tree house cat"):
    return spark.createDataFrame([(i, f"f{i}", "text", f"{words} only{'abcdefghij'[i % 10] * (i // 10 + 1)}") for i in ids], TEXTS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_equal_one(spark, tmp_path):
    """Three batches with deletions between them and merges of some are as one batch of what is left."""
    a = Index(spark, f"{tmp_path}/a", stop_words=[], fan=2)
    a.add(batch(spark, range(10)))
    a.delete(spark.createDataFrame([(2,), (3,)], "file_id long"))
    a.compact_if_grown()
    a.add(batch(spark, range(10, 20)))
    a.delete(spark.createDataFrame([(12,), (5,), (2,)], "file_id long"))
    left = [i for i in range(20) if i not in (2, 3, 5, 12)]
    b = Index(spark, f"{tmp_path}/b", stop_words=[])
    b.add(batch(spark, left))
    for again in range(3):
        assert rows(a.words) == rows(b.words) and rows(a.postings) == rows(b.postings) and rows(a.files) == rows(b.files)
        a.compact_if_grown() if not again else a.compact()
    assert a.last_id() == 19 and a.snapshot().runs[0].n_postings == b.snapshot().runs[0].n_postings


def test_words_keep_their_numbers(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/index", stop_words=[], fan=2)
    first = {"cat": 1, "house": 2, "onlya": 3, "onlyb": 4, "tree": 5}
    index.add(batch(spark, range(2)))
    assert {r["word"]: r["word_id"] for r in index.word_ids().collect()} == first
    for _ in range(2):
        index.add(batch(spark, range(2, 4), "apple house"))
        index.compact_if_grown()
        assert {r["word"]: r["word_id"] for r in index.word_ids().collect()} == first | {"apple": 6, "onlyc": 7, "onlyd": 8}
    index.delete(spark.createDataFrame([(2,)], "file_id long"))
    assert {r["word"]: (r["word_id"], r["df"]) for r in index.word_ids().collect()}["onlyd"] == (7, 1)  # onlyc has gone


def test_deleted_ids_may_come_again(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/index", stop_words=[], fan=2)
    index.add(batch(spark, range(4)))
    want = rows(index.postings)
    for _ in range(2):
        index.delete(spark.createDataFrame([(1,)], "file_id long"))
        assert index.files.count() == 3
        index.add(batch(spark, range(4)))
        assert rows(index.postings) == want
        index.compact_if_grown()
        assert rows(index.postings) == want and {r["word"]: r["df"] for r in index.words.collect()}["tree"] == 4


def test_dictionary_reads_no_lists(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/index", stop_words=[])
    index.add(batch(spark, range(5)))
    index.delete(spark.createDataFrame([(1,)], "file_id long"))
    for df in (index.words, index.dictionary):
        said = plan(df)
        assert "ReadSchema: struct<word:string,count:bigint,df:bigint>" in said and "ids" not in said and "terms" not in said
    assert "postings" not in plan(index.terms_of(2))  # what a file has comes from the catalogue
    assert rows(index.terms_of(2).select("word", "tf")) == [("cat", 1), ("house", 1), ("onlyc", 1), ("tree", 1)]


def test_tiers_bound_what_is_written_again(spark, tmp_path):
    index, n = Index(spark, f"{tmp_path}/index", stop_words=[], fan=2), 8
    for i in range(n):
        index.add(batch(spark, [i]))
        index.compact_if_grown()
        if i == 2:
            held = index.snapshot()
    last = index.snapshot()
    assert len(last.runs) == 1 and last.runs[0].batches == n and last.runs[0].level == 3
    assert last.written == 4 * n and last.rewritten <= last.written * math.log2(n)
    index.compact()
    index.compact()
    assert {r["file_id"] for r in held.postings.collect()} == {0, 1, 2} and held.files.count() == 3 and held.words.count() > 3
    assert index.snapshot(held.version).files.count() == 3
    time.sleep(0.1)
    index.vacuum(0)
    assert index.files.count() == n and len(os.listdir(tmp_path / "index/runs")) == 1
    with pytest.raises(KeyError):
        index.snapshot(held.version)


# Versions and leases.


def test_a_number_is_taken_once(spark, tmp_path):
    files = Numbered(Store(spark, f"{tmp_path}/x"), "versions", "v")
    assert files.last() == (0, None) and files.put(1, {"a": 1}) and not files.put(1, {"a": 2}) and files.last() == (1, {"a": 1})
    assert sorted(os.listdir(tmp_path / "x/versions")) == [os.path.basename(files.name(1))]


def test_a_store_that_renames(spark, tmp_path):
    """An index in a file system that isn't a local disk to this library: numbers are taken by renames without overwriting."""
    (tmp_path / "x").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.runs.link./x", f"file://{tmp_path}/x")
    store = Store(spark, "viewfs://runs/x/index")
    files = Numbered(store, "versions", "v")
    assert not store.local and files.last() == (0, None)
    assert files.put(1, {"a": 1}) and not files.put(1, {"a": 2}) and files.last() == (1, {"a": 1})
    assert store.names("versions") == [os.path.basename(files.name(1))] and files.read(2) is None
    index = Index(spark, "viewfs://runs/x/other", stop_words=[], fan=2)
    for i in range(2):
        index.add(batch(spark, [i]))
    index.compact_if_grown()
    index.delete(spark.createDataFrame([(0,)], "file_id long"))
    with index.locked(), pytest.raises(IndexInUse):
        index.compact()
    index.vacuum(0)
    assert index.snapshot().version == 4 and rows(index.files.select("file_id")) == [(1,)] and len(store.names("../other/runs")) == 2
    index.clear()
    assert index.snapshot().version == 0


def test_a_slow_writer_gives_up(spark, tmp_path):
    """Its lease ran out, another one has changed the index: what it was about to write isn't seen."""
    slow, quick = (Index(spark, f"{tmp_path}/index", stop_words=[], term=0.5) for _ in range(2))
    slow.leases.claim = lambda patience: type("Stuck", (), {"kept": lambda self: _stuck(Leases.claim(slow.leases, patience))})()
    taken = slow._write_postings

    def late(*args):
        time.sleep(1)
        quick.add(batch(spark, [5]))
        return taken(*args)

    slow._write_postings = late
    with pytest.raises(IndexInUse):
        slow.add(batch(spark, [1, 2]))
    assert rows(quick.files.select("file_id")) == [(5,)] and quick.snapshot().version == 1


class _stuck:
    """A lease that nobody renews."""

    def __init__(self, lease):
        self.lease = lease

    def __enter__(self):
        return self.lease

    def __exit__(self, *_):
        return False


def test_a_change_begins_again_after_another(spark, tmp_path):
    a, b = (Index(spark, f"{tmp_path}/index", stop_words=[]) for _ in range(2))
    put, tries = a.versions.put, []

    def raced(number, held):
        if not tries:  # the other one writes without a lease
            tries.append(number)
            b.locked = lambda: _stuck(type("Any", (), {"number": 0, "held": lambda self: True})())
            b.add(spark.createDataFrame([("f1", "text", "same name"), ("z", "text", "more")], "name string, kind string, text string"))
        return put(number, held)

    a.versions.put = raced
    a.add(spark.createDataFrame([("f1", "text", "tree"), ("f2", "text", "house")], "name string, kind string, text string"))
    assert rows(a.files.select("file_id", "name")) == [(1, "f1"), (2, "z"), (3, "f2")]
    assert {r["word"] for r in a.words.collect()} == {"same", "name", "more", "house"}


WALK = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from foliant.plans.engine import Engine
e = Engine(spark, sys.argv[1], sys.argv[2], stop_words=[], patience=120, term=float(sys.argv[3]))
if sys.argv[4] == "hang":
    write = e.index_._write_postings
    def stuck(*a):
        print("writing", flush=True)
        import time; time.sleep(600)
    e.index_._write_postings = stuck
e.index()
print("done", flush=True)
"""


def _walker(tmp_path, tree, term, how):
    return subprocess.Popen([sys.executable, "-c", WALK, f"{tmp_path}/index", str(tree), str(term), how], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, cwd=ROOT)


@pytest.fixture
def files(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for i in range(30):
        (root / f"{i:02}").write_text(f"dogs {'x' * (i + 1)}")
    return root


def test_racing_walks(spark, tmp_path, files):
    """Two processes walk the same folder at a time."""
    both = [_walker(tmp_path, files, 60, "walk") for _ in range(2)]
    assert [p.communicate(timeout=240)[0].strip() for p in both] == ["done", "done"]
    index = Index(spark, f"{tmp_path}/index", stop_words=[])
    got = rows(index.files.select("file_id", "name"))
    assert got == [(i + 1, f"{i:02}") for i in range(30)] and index.postings.count() == 60


def test_a_killed_walk_blocks_nobody(spark, tmp_path, files):
    dead = _walker(tmp_path, files, 4, "hang")
    assert dead.stdout.readline().strip() == "writing"
    dead.kill()
    dead.wait()
    index = Index(spark, f"{tmp_path}/index", stop_words=[], patience=30)
    assert index.files.count() == 0
    index.add(batch(spark, [3]))
    assert index.files.count() == 1 and index.snapshot().version == 1
    index.vacuum(0)
    assert len(os.listdir(tmp_path / "index/runs")) == 1


# Words of globs.


def test_pieces_of_globs():
    """No word that a glob matches lacks one of the glob's pieces."""
    rnd = random.Random(4)
    for _ in range(3000):
        word = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 7)))
        glob = "".join(rnd.choice("ab*?") for _ in range(rnd.randint(1, 6)))
        marked = f"^{word}$"
        pieces = {marked[i : i + 3] for i in range(len(marked) - 2)} | {marked[:2], marked[-2:]}
        if fnmatch.fnmatchcase(word, glob):
            assert set(lookup.grams_of_glob(glob)) <= pieces, (word, glob)
    assert lookup.grams_of_glob("*ation") == ["ati", "ion", "on$", "tio"] and lookup.grams_of_glob("t?e") == ["^t", "e$"] and lookup.grams_of_glob("*") == []


def _many(spark, n=3000):
    """Files with words of their own, so that postings have many row groups."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("bcdfghklmnprstvw") for _ in range(6))
    return spark.createDataFrame([(i, f"f{i}", "text", " ".join([*(word() for _ in range(30)), *(["xxation", "ztionq"] if i == 7 else [])])) for i in range(n)], TEXTS)


def scanned(df, table):
    """Rows that came out of the scans of a table: those of row groups that weren't skipped."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        if "Scan parquet" in node.nodeName() and f"/{table}" in node.toString():
            found += node.metrics().apply("numOutputRows").value()
    return found


def test_words_are_looked_up_before_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("foliant.operators.index.ROW_GROUP", 20_000)
    index = Index(spark, f"{tmp_path}/index", stop_words=[])
    index.add(_many(spark))
    for merged in (False, True):
        if merged:
            index.compact()
            assert index.snapshot().runs[0].grams
        now = index.snapshot()
        every = now.table("postings", "word string", now.runs).count()
        for glob in ("*ation", "*tion*", "?xat*", "*ionq", "*nothing*"):
            got = now.postings_of([glob])
            assert rows(got) == rows(now.postings.where(lookup.matches(F.col("word"), glob)))
            assert scanned(got, "postings") < every / 4, glob
        assert rows(now.postings_of(["*ation", "b*"])) == rows(now.postings.where("word like '%ation' or word like 'b%'"))
        monkeypatch.setattr(lookup, "LISTED", 5)  # too many words: the glob is applied to all postings
        assert rows(now.postings_of(["*b"])) == rows(now.postings.where("word like '%b'")) and now.postings_of(["*b"]).count() > 1000
        assert rows(now.postings_of(["*"])) == rows(now.postings)
        monkeypatch.setattr(lookup, "LISTED", 512)


# Names.


def test_filters_of_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(members, "NAMES_A_BLOCK", 500)
    index = Index(spark, f"{tmp_path}/index", stop_words=[])
    index.add(batch(spark, range(3000)))
    now = index.snapshot()
    assert now.runs[0].filters == 6
    has, others = (spark.createDataFrame([(f"f{i}",) for i in some], "name string") for some in (range(3000), range(3000, 9000)))
    assert members.shown(now, has).count() == 3000 and members.shown(now, others).count() < 20


def test_new_names_read_no_catalogue(spark, tmp_path, monkeypatch):
    index = Index(spark, f"{tmp_path}/index", stop_words=[])
    index.add(batch(spark, range(100)))
    read = []
    real = type(index.snapshot()).rows
    monkeypatch.setattr(type(index.snapshot()), "rows", lambda self, runs=None: (read.append(runs), real(self, runs))[1])
    index.add(batch(spark, range(100, 200)))
    assert read == []
    index.add(batch(spark, range(150, 210)))  # half of them are known, by the second run only
    assert [[r.seq for r in runs] for runs in read] == [[2]]
    assert index.files.count() == 210
