"""Globs, find, lines, pages, statistics."""

import fnmatch
import random
import re

from pyspark.sql import functions as F

from foliant.functions.globs import like_pattern, matches
from foliant.operators import search, stats

POSTINGS = [("alpha", 1, 2), ("beta", 1, 1), ("gamma", 1, 1), ("alpha", 2, 5), ("beta", 2, 1), ("delta", 3, 1), ("a_b%", 3, 1)]
FILES = [(1, "one.txt"), (2, "two.txt"), (3, "dir/three.txt")]


def tables(spark):
    return spark.createDataFrame(POSTINGS, "word string, file_id long, tf long"), spark.createDataFrame(FILES, "file_id long, name string")


def ids(df):
    return sorted(r["file_id"] for r in df.collect())


def test_globs(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("ab%_\\*?é🙂") for _ in range(rng.randint(0, 5))) for _ in range(300)]
    globs = ["a*", "*b", "?", "a?b", "%", "_", "\\*", "*%*", "", "*", "a_*", "*?b*"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", *[matches(F.col("v"), g).alias(f"m{i}") for i, g in enumerate(globs)]).collect()
    for r in rows:
        for i, g in enumerate(globs):
            pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g)
            assert r[f"m{i}"] == bool(re.fullmatch(pattern, r["v"], re.S)), (g, r["v"])
    assert like_pattern("a%*") == "a\\%%"
    assert fnmatch.fnmatchcase("abc", "a*")


def test_prefix_reaches_the_scan(spark, tmp_path):
    tables(spark)[0].write.parquet(f"{tmp_path}/p")
    plan = search.find_ids(spark.read.parquet(f"{tmp_path}/p"), ["al*", "beta"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "StringStartsWith(word,al)" in plan
    assert "EqualTo(word,beta)" in plan
    assert "tf" not in re.search(r"ReadSchema: (.*)", plan)[1]


def test_find(spark):
    p, f = tables(spark)
    assert ids(search.find(p, f, ["alpha"])) == [1, 2]
    assert ids(search.find(p, f, ["al*", "g*"])) == [1]
    assert ids(search.find(p, f, ["*a", "de?ta"])) == [3]
    assert ids(search.find(p, f, ["alpha", "nothing"])) == []
    assert ids(search.find(p, f, ["ALPHA"])) == []
    assert ids(search.find(p, f, ["a_b%"])) == [3]
    assert ids(search.find(p, f, [])) == []
    assert ids(search.find(p, f.where("file_id <> 2"), ["alpha"])) == [1]
    assert ids(search.find(p, f, ["alpha"] * 70 + ["b*"])) == [1, 2]


def test_lines(spark):
    p, f = tables(spark)
    texts = spark.createDataFrame([(1, "Alpha beta\nx alpha y\n\nbeta,"), (3, "nothing")], "file_id long, text string")
    got = {r["file_id"]: r["lines"] for r in search.find_with_lines(p, f, texts, ["alpha", "b*a"]).collect()}
    assert got == {1: ["Alpha beta", "x alpha y"], 2: []}


def test_pages(spark):
    found = spark.createDataFrame([(i, f"f{i}", []) for i in range(45, 0, -1)], "file_id long, name string, lines array<string>")
    pager = search.Pager(found)
    assert [r["file_id"] for r in pager.first()] == list(range(1, 21)) and pager.has_more
    assert [r["file_id"] for r in pager.next()] == list(range(21, 41)) and pager.has_more
    assert [r["file_id"] for r in pager.next()] == list(range(41, 46)) and not pager.has_more
    assert [r["file_id"] for r in pager.first()][0] == 1
    assert [r["file_id"] for r in search.page(found, 2).collect()] == list(range(41, 46))


def test_statistics(spark):
    p, f = tables(spark)
    words = stats.word_stats(p)
    assert sorted(words.collect())[1] == ("alpha", 7, 2)
    bags = {r["word"]: r["freq_bag"] for r in stats.frequency_bags(words).collect()}
    assert bags["alpha"] == 255 and stats.frequency_bags(words.where("false")).count() == 0
    assert [tuple(r) for r in stats.df_histogram(words).orderBy("df").collect()] == [(1, 3, 60.0), (2, 2, 100.0)]
    assert stats.rare_words(words, f.agg(F.count(F.lit(1)).alias("n")), 0.34).count() == 3
    assert stats.index_stats(f, words).first() == (3, 5, 12, 7)
    assert stats.index_stats(f.where("false"), words.where("false")).first() == (0, 0, 0, 0)
    assert [tuple(r) for r in stats.inverted_frequencies(p).where("file_id = 1").drop("file_id").orderBy("tf").collect()] == [(1, ["beta", "gamma"]), (2, ["alpha"])]
    assert stats.posting_stats(p, "none").first() == (0, 0, None, None)
