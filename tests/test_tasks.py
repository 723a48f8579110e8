"""A task's share is bounded by entries and bytes, not by how many partitions a session happens to have; results don't depend on it."""

import glob

import pytest
from pyspark.sql import functions as F

from foliant.operators import index as module
from foliant.operators import lookup, members, tokens
from foliant.operators.index import Index
from foliant.operators.stats import inverted_frequencies


def texts(spark, n):
    return spark.range(n).select(F.col("id").alias("file_id"), F.format_string("f%d", "id").alias("name"), F.lit("text").alias("kind"), F.format_string("tree w%s tree house", F.conv(F.col("id").cast("string"), 10, 2)).alias("text")).repartition(2)


def parts(path, table):
    """Files with rows, a task's each."""
    import pyarrow.parquet as pq

    return sum(pq.read_metadata(f).num_rows > 0 for f in glob.glob(f"{path}/runs/*/{table}/*.parquet"))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(module, "ENTRIES_A_TASK", 50, raising=False)
    monkeypatch.setattr(module, "BYTES_A_TASK", 500, raising=False)


@pytest.mark.usefixtures("small")
def test_postings_and_files_are_dealt_by_their_number(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/index", stop_words=[])
    index.add(texts(spark, 60).withColumn("text", F.translate("text", "01", "ab")))
    assert parts(f"{tmp_path}/index", "files") >= 3 and parts(f"{tmp_path}/index", "postings") >= 3
    got = {(r["word"], r["count"], r["df"]) for r in index.words.where("word in ('tree', 'house')").collect()}
    assert got == {("tree", 120, 60), ("house", 60, 60)}
    assert index.postings.count() == 60 * 3 and index.terms_of(7).where("word = 'tree'").first()["tf"] == 2


def test_words_are_counted_in_their_row(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["é"])], "id int, terms array<string>")
    got = rows.select("id", F.inline(tokens.counted(F.col("terms"))))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (1, "b", 2), (4, "é", 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.usefixtures("small")
def test_walked_files_are_dealt_by_their_bytes(spark, tmp_path):
    """Not by the list of their names, which is short however much they hold."""
    from foliant.plans.engine import Engine

    (tmp_path / "tree").mkdir()
    for i in range(20):
        (tmp_path / "tree" / f"{i}.txt").write_text("tree house " * 10)
    engine = Engine(spark, f"{tmp_path}/index", f"{tmp_path}/tree", stop_words=[])
    engine.index()
    assert parts(f"{tmp_path}/index", "files") >= 3
    assert [(r["word"], r["count"], r["df"]) for r in engine.words().collect()] == [("house", 200, 20), ("tree", 200, 20)]


def test_terms_are_stored_counted(spark, tmp_path):
    """So they aren't counted again by each pass over a run; runs whose terms are all words are read as before."""
    index = Index(spark, f"{tmp_path}/index", stop_words=[])
    rows = [(1, "f1", "text", "b a b"), (2, "f2", "text", ""), (3, "f3", "ignore", None)]
    index.add(spark.createDataFrame(rows, "file_id long, name string, kind string, text string"))
    got = {r["file_id"]: (r["terms"], r["tfs"], r["token_count"]) for r in index.snapshot().rows().collect()}
    assert got == {1: (["a", "b"], [1, 2], 3), 2: ([], [], 0), 3: (None, None, 0)}
    run = index.snapshot().runs[0].id
    held = index.snapshot().rows().withColumn("terms", F.when(F.col("file_id") == 1, F.array(F.lit("b"), F.lit("a"), F.lit("b")))).drop("tfs").collect()
    old = f"{tmp_path}/index/runs/{run}/files"
    spark.createDataFrame(held, "seq long, file_id long, name string, kind string, token_count long, error string, terms array<string>").write.mode("overwrite").parquet(old)
    assert sorted(tuple(r) for r in index.terms_of(1).collect()) == [(1, "a", 1), (1, "b", 2)]
    index.delete(spark.createDataFrame([(1,)], "file_id long"))
    assert index.words.count() == 0 and index.compact().postings.count() == 0


@pytest.mark.usefixtures("small")
def test_a_task_reads_a_bounded_part_of_a_run(spark, tmp_path, monkeypatch):
    """Splits of a scan grow with the table up to 128 MB, and the writer of a shuffle holds all that is made of one."""
    monkeypatch.setattr(module, "BYTES_A_TASK", 50)
    monkeypatch.setattr(module, "BYTES_A_SPLIT", 2000, raising=False)
    index = Index(spark, f"{tmp_path}/index", stop_words=[])
    index.add(texts(spark, 60))
    run = index.snapshot().runs[0].id
    n = parts(f"{tmp_path}/index", "files")
    assert n > 12 and index._counted(run)._jdf.rdd().getNumPartitions() >= n
    assert index._counted(run).count() == index.postings.count() == index.compact().postings.count()
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") in ("134217728b", "134217728", "128MB")


def test_texts_of_a_large_scan_are_shuffled_and_not_their_words(spark, tmp_path):
    for i in range(9):  # as many splits as cores, at least
        spark.createDataFrame([(i, "tree house tree"), (i + 100, "tree"), (1, "tree")], "file_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "600")
    try:
        frequencies = tokens.term_frequencies(spark.read.parquet(f"{tmp_path}/t"), [])
        plan = inverted_frequencies(frequencies)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # a plan is written from its end
        got = {(r["file_id"], r["word"]): r["tf"] for r in frequencies.collect()}
        assert got[1, "tree"] == 11 and got[105, "tree"] == 1 and len(got) == 9 + 9 + 9
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.usefixtures("small")
def test_words_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """The dictionary is added up, and its words numbered and cut into pieces, by tasks of bounded shares, not by a session's partitions."""
    monkeypatch.setattr(module, "WORDS_A_TASK", 6, raising=False)
    monkeypatch.setattr(lookup, "PIECES_A_TASK", 50)
    index = Index(spark, f"{tmp_path}/index", stop_words=[])
    index.add(texts(spark, 60).withColumn("text", F.translate("text", "01", "ab")))
    spark.sparkContext.setJobGroup("merge", "merge")
    index.compact()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    n = parts(f"{tmp_path}/index", "grams")
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("merge") for s in status.getJobInfo(j).stageIds}
    ran = [i.numTasks for s in stages if (i := status.getStageInfo(s)) and i.numCompletedTasks]
    words = index.word_ids().orderBy("word_id").collect()
    assert len(words) == 62 and [r["word_id"] for r in words] == list(range(1, 63)) and [r["word"] for r in words] == sorted(r["word"] for r in words)
    assert n >= 8 and sum(x >= n for x in ran) >= 2  # those that make pieces, and those that sort them
    assert index.dictionary.rdd.getNumPartitions() >= 62 // 6


def test_a_name_that_only_filters_show_needs_no_join(spark, tmp_path, monkeypatch):
    """A few new names are always shown by filters; texts were joined by name for them."""
    index = Index(spark, f"{tmp_path}/index", stop_words=[])
    index.add(texts(spark, 3))
    new = texts(spark, 6).where("file_id > 2").select("name")
    seen = members.shown
    monkeypatch.setattr(members, "shown", lambda snapshot, names: seen(snapshot, names).union(names.select(F.lit(snapshot.runs[0].id).alias("run"), "name")))
    names, every = members.unknown(index.snapshot(), new, f"{tmp_path}/new")
    assert every and names.count() == 3
    names, every = members.unknown(index.snapshot(), texts(spark, 6).select("name"), f"{tmp_path}/some")
    assert not every and sorted(r["name"] for r in names.collect()) == ["f3", "f4", "f5"]


def test_entries_are_gathered_as_numbers(spark, tmp_path, monkeypatch):
    """A struct for each entry took more time than tokenizing; a number holds a file's place in its block and its tf, whatever the ids."""
    kinds, write = [], Index._write_lists
    monkeypatch.setattr(Index, "_write_lists", lambda self, held, *a: kinds.append(dict(held.dtypes)["held"]) or write(self, held, *a))
    ids = [-(1 << 40), -65537, -65536, -1, 0, 65535, 65536, (1 << 40) + 7]
    index = Index(spark, f"{tmp_path}/index", stop_words=[], fan=3)
    for half in (ids[:4], ids[4:]):
        index.add(spark.createDataFrame([(i, f"f{i}", "text", "b a b " * (1 + i % 3)) for i in half], "file_id long, name string, kind string, text string"))
    want = {(w, i, n * (1 + i % 3)) for i in ids for w, n in (("a", 1), ("b", 2))}
    assert {tuple(r) for r in index.postings.collect()} == want
    index.delete(spark.createDataFrame([(-1,)], "file_id long"))
    index.compact_if_grown()  # two runs and what was deleted from them
    assert {tuple(r) for r in index.postings.collect()} == {x for x in want if x[1] != -1}
    assert all(r["ids"] == sorted(r["ids"]) for r in index.snapshot().table("postings", module.POSTINGS, index.snapshot().runs).collect())
    assert sum(r.n_tokens for r in index.snapshot().runs) == sum(x[2] for x in want if x[1] != -1)
    assert len(kinds) == 3 and set(kinds) == {"array<bigint>"}
    assert int(index.writer.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold")) == module.WORDS_A_TASK
    assert index.writer.conf.get("spark.sql.execution.useObjectHashAggregateExec") != "false"


def test_words_are_told_from_stop_words_in_one_pass(spark):
    df = spark.createDataFrame([("Tree, the house é 1 ÉT\nfrom: x\nİ tree",), ("",), (None,)], "text string")
    got = df.select(tokens.term_array(F.col("text"), ["the"]).alias("t"), tokens.term_array(F.col("text"), []).alias("every"))
    assert got.select("t")._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 1
    rows = got.collect()
    assert rows[0]["t"] == ["tree", "house", "é", "ét", "i̇", "tree"] and rows[0]["every"] == ["tree", "the", *rows[0]["t"][1:]]
    assert [tuple(r) for r in rows[1:]] == [([], []), (None, None)]


def test_a_partial_merge_joins_files_and_not_entries(spark, tmp_path, monkeypatch):
    """With what was deleted: there are some hundred entries a file."""
    plans, write = [], Index._write_lists
    monkeypatch.setattr(Index, "_write_lists", lambda self, held, *a: plans.append(held._jdf.queryExecution().optimizedPlan().toString()) or write(self, held, *a))
    index = Index(spark, f"{tmp_path}/index", stop_words=[], fan=2)
    add = lambda *ids: index.add(spark.createDataFrame([(i, f"f{i}", "text", f"b a b x{chr(97 + i % 26)}") for i in ids], "file_id long, name string, kind string, text string"))
    add(1, 2)
    add(3)
    index.compact_if_grown()
    add(4, 4464)
    add(70005)
    monkeypatch.setattr(index, "fan", 3)
    index.delete(spark.createDataFrame([(1,), (4,)], "file_id long"))
    plans.clear()
    index.compact_if_grown()
    assert len(plans) == 1 and "Join" not in plans[0] and len(index.snapshot().runs) == 2
    left = (2, 3, 4464, 70005)
    assert {tuple(r) for r in index.postings.collect()} == {x for i in left for x in (("a", i, 1), ("b", i, 2), (f"x{chr(97 + i % 26)}", i, 1))}
    assert {(r["word"], r["count"], r["df"]) for r in index.words.collect()} == {("a", 4, 4), ("b", 8, 4)} | {(f"x{chr(97 + i % 26)}", 1, 1) for i in left}
    assert [r["word"] for r in index.word_ids().orderBy("word_id").collect()] == ["a", "b", "xc", "xd", "xs", "xn"]
