"""The index on disk: walks, streams, deletion, recovery, compaction, and the prompt."""

import io
import os
import time

import pytest
from pyspark.sql import functions as F

from foliant.cli import Prompt
from foliant.operators.index import POSTINGS, Index, IndexInUse
from foliant.plans.engine import Engine
from foliant.sources import files as file_source
from foliant.streaming import incremental
from foliant.streaming.control import Control


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree dir"
    (root / "sub").mkdir(parents=True)
    (root / "b.txt").write_text("Dogs chase birds\nbirds fly")
    (root / "a.html").write_text("<html><p>Birds &amp; trees</p>")
    (root / "sub" / "c").write_bytes(b"\x00binary dogs")
    (root / "sub" / "d.pdf").write_text("dogs")
    (root / "sub" / "e.txt").write_bytes(b"caf\xc3\xa9 \xff dogs")
    (root / "empty").write_text("")
    (root / "_hidden").write_text("dogs hide")
    (root / "link").symlink_to(root / "b.txt")
    return root


def names(df):
    return [r["name"] for r in df.collect()]


def test_walk(spark, tree, tmp_path):
    e = Engine(spark, f"{tmp_path}/index", str(tree), stop_words=["the"])
    e.index()
    assert [(r["file_id"], r["name"], r["kind"], r["token_count"]) for r in e.files().collect()] == [
        (1, "_hidden", "text", 2), (2, "a.html", "html", 2), (3, "b.txt", "text", 5), (4, "empty", "text", 0), (5, "sub/c", "ignore", 0), (6, "sub/e.txt", "text", 2),
    ]
    assert e.problems().collect() == [("sub/c", "maybe binary file")]
    assert names(e.find("bird*")) == ["a.html", "b.txt"]
    assert names(e.find("bird*", "dogs")) == ["b.txt"]
    assert names(e.find_files("sub/*")) == ["sub/c", "sub/e.txt"]
    assert [r["lines"] for r in e.find_lines("birds").collect()] == [[], ["Dogs chase birds", "birds fly"]]
    (tree / "new.txt").write_text("dogs again")
    (tree / "b.txt").write_text("changed")
    e.index()
    assert e.file(7).first()["name"] == "new.txt" and names(e.find("changed")) == []
    assert e.stats().first()["n_files"] == 7 and e.last_id() == 7
    assert [(r["n_files"], r["last_id"]) for r in e.write_stats().collect()] == [(6, 6), (1, 7)]
    assert [tuple(r) for r in e.inverted(7).collect()] == [(1, ["dogs"])] or "again" in str(e.inverted(7).collect())
    (tree / "b.txt").unlink()
    assert [r["lines"] for r in e.find_lines("chase").collect()] == [[]]
    e.delete("sub/*")
    assert names(e.find("dogs")) == ["_hidden", "b.txt", "new.txt"]
    copy = e.save(f"{tmp_path}/copy")
    assert names(copy.find("dogs")) == ["_hidden", "b.txt", "new.txt"] and copy.index_.deleted.count() == 0
    assert copy.words().count() == e.words().count()
    e.index()  # a deleted name may come again
    assert names(e.find("caf?")) == ["sub/e.txt"]


def test_stream_equals_batch(spark, tree, tmp_path):
    """Empty, hidden and linked files included; and going on from a checkpoint adds nothing."""
    a, b = Engine(spark, f"{tmp_path}/a", str(tree)), Engine(spark, f"{tmp_path}/b", str(tree))
    a.index()
    b.index_stream(f"{tmp_path}/checkpoint", per_batch=2)
    assert b.write_stats().where("n_files > 2").count() == 0
    (tree / "new.txt").write_text("dogs again")
    a.index()
    query = b.start_stream(f"{tmp_path}/checkpoint", per_batch=2)
    assert len(b.running()) <= 1
    query.awaitTermination()
    assert query.lastProgress is not None and b.running() == []
    version = b.index_.snapshot().version
    b.index_stream(f"{tmp_path}/checkpoint", per_batch=2)
    assert b.index_.snapshot().version == version
    rows = lambda e: sorted(e.index_.postings.join(e.index_.files, "file_id").select("name", "word", "tf").collect())
    files = lambda e: sorted(e.index_.files.select("name", "kind", "token_count").collect())
    assert rows(a) == rows(b) and len(rows(a)) > 5 and files(a) == files(b) and len(files(a)) == 7


def test_messages_between_batches(spark, tree, tmp_path):
    """A stream is held, goes on, merges, quits after some batches, and goes on from there to what one go gives."""
    one, e = Engine(spark, f"{tmp_path}/one", str(tree)), Engine(spark, f"{tmp_path}/index", str(tree))
    one.index()
    first = e.control("pause")
    query = e.start_stream(f"{tmp_path}/checkpoint", per_batch=1)
    while e.answered(first) is None:
        time.sleep(0.1)
    time.sleep(1)
    assert query.isActive and e.index_.snapshot().version == 0 and e.answered(first)["batch"] == 0
    on, save = e.control("resume"), e.control("save")
    while e.index_.snapshot().version < 2:
        time.sleep(0.05)
    assert e.answered(on)["batch"] == 0
    stop = e.control("quit")
    assert not incremental.finished(query)
    assert e.answered(stop)["message"] == "quit" and e.answered(save) is not None and Control(e.index_).open() == []
    n = e.index_.files.count()
    assert 0 < n < 6
    assert e.progress.of(query.name) and e.progress.of(query.name)[0]["rows"] == 1
    assert e.index_stream(f"{tmp_path}/checkpoint", per_batch=1)
    files = lambda x: sorted(x.index_.files.select("name", "kind", "token_count").collect())
    assert files(e) == files(one) and sorted(e.words().collect()) == sorted(one.words().collect())
    with pytest.raises(ValueError):
        e.control("dance")


def test_batch_that_dies_is_found_again(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/index")
    texts = spark.createDataFrame([(7, "x", "text", "tree house"), (8, None, "text", "lost"), (9, "y", "ignore", None)], "file_id long, name string, kind string, text string")
    lost = spark.createDataFrame([(1, 1, "tree", 0, 1, 1, [7], [1])], POSTINGS)
    lost.write.parquet(f"{tmp_path}/index/runs/dead/postings")
    assert index.postings.count() == 0
    index.add(texts)
    assert sorted(index.postings.collect()) == [("house", 7, 1), ("tree", 7, 1)] and index.files.count() == 2
    index.add(texts)
    assert index.postings.count() == 2
    index.add(texts.where("false"))
    assert index.words.select(F.sum("count")).first()[0] == 2
    index.vacuum(0)
    assert not (tmp_path / "index/runs/dead").exists() and index.postings.count() == 2


def test_prompt(spark, tree, tmp_path):
    out = io.StringIO()
    p = Prompt(Engine(spark, f"{tmp_path}/index", str(tree)), stdout=out)
    for line in ("index", "find birds", "next", "first", "files *.txt", "stats base", "stats word birds", "stats 7", "stats debug", "stats writes", "stats problems", "summary 1", "store", "delete b.txt", "files *", "nonsense", "find", "?", "help", ""):
        assert not p.onecmd(line)
    text = out.getvalue()
    assert "  0:a.html" in text and "    Dogs chase birds" in text
    assert "nonsense\n^ unknown command: nonsense" in text and "find\n    ^ expected GLOB..." in text and "stats 7\n      ^ expected one of base" in text
    assert "last batch: {" in text and "again: [" not in text and ": [1] n=" in text and "sub/c: maybe binary file" in text
    assert p.complete_stats("d") == ["debug"] and p.completenames("f") == ["find", "files", "first"] and p.onecmd("quit")
    assert (p.hint("ind"), p.hint("f"), p.hint("find "), p.hint("find a")) == ("ex", "", "GLOB...", "")
    with p.engine.index_.locked():
        p.onecmd("index")
    assert "refused: " in out.getvalue() and "done here: {'step': 'load and tokenize'" in text and "'files': 6" in text
    p.onecmd("control nothing")
    p.onecmd("control pause")
    p.completedefault("", "find ")
    assert "control nothing\n        ^ expected one of pause" in out.getvalue() and "message 1\n" in out.getvalue() and out.getvalue().endswith("\nGLOB...\n> find ")
    assert p.complete_control("re") == ["resume"]


def test_history(spark, tmp_path):
    readline = pytest.importorskip("readline")
    p = Prompt(None, f"{tmp_path}/history.txt", stdin=io.StringIO("help\nquit\n"), stdout=io.StringIO())
    p.use_rawinput = False
    readline.clear_history()
    readline.add_history("find birds")
    p.cmdloop()
    readline.clear_history()
    p.preloop()
    assert readline.get_history_item(1) == "find birds"


def test_one_change_at_a_time(spark, tree, tmp_path):
    a, b = (Engine(spark, f"{tmp_path}/index", str(tree)) for _ in range(2))
    with a.index_.locked():
        for change in (b.index, b.save, lambda: b.delete("*")):
            with pytest.raises(IndexInUse):
                change()
    b.index()
    assert a.last_id() == 6
    a.index_.leases.claim()  # of an application that died
    with pytest.raises(IndexInUse):
        a.delete("nothing")
    a.unlock()
    a.index()
    assert a.last_id() == 6


def test_compaction_in_place(spark, tree, tmp_path):
    e = Engine(spark, f"{tmp_path}/index", str(tree))
    e.index()
    e.delete("a.html")
    before = e.index_.snapshot()
    for i in range(3):
        want = sorted(e.index_.postings.collect())
        e.save()
        assert sorted(e.index_.postings.collect()) == want and e.index_.deleted.count() == 0 and e.last_id() == 6
        assert len(e.index_.snapshot().runs) == 1 and e.index_.snapshot().version == 3 + i
    assert names(e.find("bird*")) == ["b.txt"]
    assert sorted(before.postings.collect()) == want and sorted(before.words.select("word").collect()) == sorted({(r["word"],) for r in want})
    (tree / "new").write_text("dogs")
    e.index()
    assert len(e.index_.snapshot().runs) == 2 and e.last_id() == 8  # a.html has come again
    (tmp_path / "index" / "runs" / "dead").mkdir()  # a compaction that died
    assert names(e.find("bird*")) == ["b.txt", "a.html"]


def test_files_that_cant_be_read(spark, tree, tmp_path):
    listed = file_source.list_files(spark, str(tree))
    lost = spark.createDataFrame([("gone", f"{tree}/gone", 1, None), ("x", f"{tree}/x", None, "no way in")], listed.schema)
    index = Index(spark, f"{tmp_path}/index")
    index.add_files(listed.union(lost), incremental.loaded(str(tree)))
    assert index.files.where("name in ('gone', 'x')").count() == 0 and index.files.count() == 6
    said = dict(map(tuple, index.problems.collect()))
    assert "No such file" in said["gone"] and said["x"] == "no way in"
    index.add_files(lost, incremental.loaded(str(tree)))  # nothing but errors
    assert index.problems.where("name = 'x'").count() == 2 and index.files.count() == 6 and index.batches.count() == 1
    index.compact()
    assert index.problems.count() == 5 and index.files.count() == 6 and index.words.count() > 5
    (tree / "gone").write_text("back again")
    index.add_files(file_source.list_files(spark, str(tree)), incremental.loaded(str(tree)))
    assert index.files.where("name = 'gone'").count() == 1
    missing = file_source.list_files(spark, f"{tmp_path}/nothing").collect()
    assert len(missing) == 1 and missing[0]["error"]


def test_many_folders_are_shared_out(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"r/{i}/deep/er").mkdir(parents=True)
        (tmp_path / f"r/{i}/deep/er/{i}.txt").write_text("x")
        (tmp_path / f"r/{i}/a.txt").write_text("yy")
    got = file_source.list_files(spark, str(tmp_path / "r")).collect()
    assert {(r["name"], r["length"]) for r in got} == {(f"{i}/deep/er/{i}.txt", 1) for i in range(60)} | {(f"{i}/a.txt", 2) for i in range(60)}
    assert len(got) == 120


def test_flat_folder_is_shared_out(spark, tmp_path, monkeypatch):
    """Of a folder with 200,000 files the driver reads a few; tasks have slices of it."""
    flat = tmp_path / "flat"
    (flat / "sub").mkdir(parents=True)
    (flat / "sub" / "one").write_text("x")
    for i in range(200_000):
        os.close(os.open(f"{flat}/{i}", os.O_CREAT | os.O_WRONLY))
    seen = []
    made = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, *a, **k: (seen.append(len(rows)), made(self, rows, *a, **k))[1])
    listed = file_source.list_files(spark, str(flat))
    got = listed.groupBy(F.spark_partition_id()).count().collect()
    assert seen and max(seen) <= 2 * spark.sparkContext.defaultParallelism + 1
    assert len(got) >= spark.sparkContext.defaultParallelism and sum(r[1] for r in got) == 200_001
    assert max(r[1] for r in got) < 100_000
    assert listed.where("name = 'sub/one'").count() == 1 and listed.select("name").distinct().count() == 200_001


def test_pages_open_their_files_only(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for i in range(50):
        (root / f"{i:02}.txt").write_text(f"dogs number {i}\nother line")
    e = Engine(spark, f"{tmp_path}/index", str(root), stop_words=[])
    e.index()
    pager, shown = e.find_pages("dog*", "*mber"), []
    show = pager.show
    pager.show = lambda some: (shown.append(some.count()), show(some))[1]
    for i in range(20, 50):
        (root / f"{i:02}.txt").unlink()  # of later pages
    first = pager.first()
    assert [r["name"] for r in first] == [f"{i:02}.txt" for i in range(20)] and all(r["lines"] == [f"dogs number {i}"] for i, r in enumerate(first))
    e.delete("*")  # results stay as they were found
    assert [r["name"] for r in pager.next()] == [f"{i:02}.txt" for i in range(20, 40)] and pager.has_more
    assert len(pager.next()) == 10 and not pager.has_more and shown == [20, 20, 10]
    assert pager.first() == first
    assert e.find_pages("nothing").first() == []
