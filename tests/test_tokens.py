"""The tokenizer by rule, against a scanner of its own, and with stop words."""

import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions.stopwords import default_list, is_stop_word, read_list
from foliant.functions.text import cut_term, term, words
from foliant.operators import stats, tokens
from foliant.sources import tables

CASES = [
    ("Hello, World 42!", "Hello World"),
    ("don't stop", "don t stop"),
    ("abc123def", "abc def"),
    ("Straße Ünï", "Straße Ünï"),
    ("Subject: hi\nbody text", "Subject hi body text"),
    ("x\nSubject: hi\nbody text", "x body text"),
    ("x\n  http://a.b/c d\ny", "x y"),
    ("x\n:gone\ny", "x y"),
    ("a\rKey: v", "a Key v"),
    ("<b>bold</b> move", "bold b move"),
    ("x <b>bold</b>", "x b bold b"),
    ("x\n<i><b>bold", "x bold"),
    ("x\n<aaaaaaaaaaaaaaaaaaaaa>y", "x aaaaaaaaaaaaaaaaaaaaa y"),
    ("x\nbegin 644 f\nM86\n`\nend\ny", "x y"),
    ("x\nbegin 644 f\nM86\nend\ny", "x begin f M end y"),
    ("x\nBEGIN k\nQUJD\nEND k\ny", "x y"),
    ("x\n-----BEGIN PGP SIGNATURE-----\niQ\n-----END PGP SIGNATURE-----\ny", "x y"),
    ("x\n-----BEGIN PGP SIGNATURE-----\niQ\n------END PGP SIGNATURE-----\ny", "x BEGIN PGP SIGNATURE iQ END PGP SIGNATURE y"),
    ("", ""),
    ("\n\n  \n", ""),
]


def split(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", words(F.col("t")).alias("w")).collect()
    return [r["w"] for r in sorted(rows)]


def test_rules(spark):
    assert [" ".join(w) for w in split(spark, [c[0] for c in CASES])] == [c[1] for c in CASES]


def scan(text):
    """A scanner for texts without the multi-line blocks: header lines, tags, words."""
    out, i = [], 0
    while i < len(text):
        if text[i] in "\n\r":
            j = i + 1
            while j < len(text) and text[j].isspace():
                j += 1
            k = j
            while k < len(text) and (text[k].isascii() and text[k].isalnum() or text[k] in "*-"):
                k += 1
            if k < len(text) and text[k] == ":":
                while k < len(text) and text[k] != "\n":
                    k += 1
                i = k
                continue
        if text[i] == "<" and 2 <= (end := text.find(">", i)) - i <= 21:
            i = end + 1
            continue
        if text[i].isalpha():
            j = i
            while j < len(text) and text[j].isalpha():
                j += 1
            out.append(text[i:j])
            i = j
            while i < len(text) and not text[i].isalpha() and text[i] != "\n":
                i += 1
        elif text[i] != "\n" and not (text[i] == "\r" and False):
            while i < len(text) and not text[i].isalpha() and text[i] != "\n":
                i += 1
        else:
            i += 1
    return out


def test_against_scanner(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aBé<>:: \n\r*-1.") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert split(spark, texts) == [scan(t) for t in texts]


def test_long_text_does_not_overflow(spark):
    block = "x\nbegin 644 f\n" + "M86\n" * 30000 + "`\nend\ny"
    assert split(spark, [block, "word " * 100000])[0] == ["x", "y"]


def test_terms(spark, tmp_path):
    assert spark.range(1).select(term(F.lit("ΟΔΟΣ")), term(F.lit("İ"))).first() == ("οδος", "i̇")
    assert {"the", "und", "avec", "x"} <= set(default_list())
    (tmp_path / "stop").write_text("Foo\nbar baz\n\nqux\n")
    assert read_list(str(tmp_path / "stop")) == ("foo", "qux")
    (tmp_path / "source").write_text('LIST = [\n    "foo",\n    "l\'eau",\n    "foo",\n    "süß"\n];\n')
    assert read_list(str(tmp_path / "source")) == ("foo", "süß")
    df = spark.createDataFrame([("foo",), ("the",)], "w string")
    assert [r[0] for r in df.where(is_stop_word("w", ["foo"])).collect()] == ["foo"]


def test_counts_without_words(spark):
    df = spark.createDataFrame([(1, "the the"), (2, ""), (3, "tree house The")], "file_id long, text string")
    assert sorted(tokens.token_counts(df).collect()) == [(1, 0, 2), (2, 0, 0), (3, 2, 3)]
    assert sorted(tokens.term_frequencies(df, ["house"]).collect()) == [(1, "the", 2), (3, "the", 1), (3, "tree", 1)]


@pytest.mark.parametrize(("word", "cut"), [("abcdefghijklmnopqrsü", "abcdefghijklmnopqrs"), ("ü" * 20, "ü" * 9), ("short", "short"), ("a" * 25, "a" * 20)])
def test_cut_term(spark, word, cut):
    assert spark.createDataFrame([(word,)], "w string").select(cut_term(F.col("w"))).first()[0] == cut


def test_the_list_is_a_parameter(spark, sf, tmp_path, monkeypatch):
    (tmp_path / "list").write_text("token\nthe\n")
    monkeypatch.setenv("FOLIANT_STOP_WORDS", str(tmp_path / "list"))
    assert default_list() == ("the", "token")
    df = spark.createDataFrame([(1, "the token and")], "file_id long, text string")
    assert [tuple(r) for r in tokens.term_frequencies(df).collect()] == [(1, "and", 1)]
    assert [tuple(r) for r in tokens.token_counts(df).collect()] == [(1, 1, 3)]


@pytest.mark.skipif("TEST_STOP_WORDS" not in os.environ, reason="needs the list of an older index")
def test_counts_with_the_list_of_an_older_index(spark):
    """With its 1,386 words, of which 1,356 are letters only, the counts are those of the survey."""
    words = read_list(os.environ["TEST_STOP_WORDS"])
    assert len(words) == 1356
    for sf, want in (("0.001", (200, 22539, 55364, 46273)), ("0.01", (1000, 68606, 272680, 229858))):
        docs = tables.documents(spark, f"/root/testdata/sf{sf}")
        assert stats.index_stats(docs, stats.word_stats(tokens.term_frequencies(docs, words))).first() == want


def test_a_small_scan_is_shuffled_once(spark, tmp_path):
    spark.createDataFrame([(1, "the red house, the house"), (2, "a red tree"), (2, "red"), (None, "red")], "file_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    counts = tokens.term_frequencies(spark.read.parquet(f"{tmp_path}/t"), ["the", "a"])
    assert sorted(map(str, counts.collect())) == sorted(
        ["Row(file_id=1, word='red', tf=1)", "Row(file_id=1, word='house', tf=2)", "Row(file_id=2, word='red', tf=2)", "Row(file_id=2, word='tree', tf=1)", "Row(file_id=None, word='red', tf=1)"]
    )
    assert counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
