import html as stdlib
import random

from pyspark.sql import functions as F

from foliant.functions.html import html_to_text

CASES = [
    ("<p>a</p><p>b</p>", "ab"),
    ("a<!-- x > y -->b", "a y -->b"),
    ("<![CDATA[zz]]>q", ">q"),
    ("a < b & c", "a < b & c"),
    ("</ FONT>x", "</ FONT>x"),
    ("<script>var t=1;</script>z", "var t=1;z"),
    ("Fish &amp; Chips", "Fish & Chips"),
    ("&#65;&#x42;&#55296;", "AB&#55296;"),
    ("&zzz; ok", "&zzz; ok"),
    ("a<br", "a"),
    ("<?php x?>y", "y"),
    ("<!DocType html>y", "y"),
    ("a\0b", "a"),
    ("&notin; &notit; &ampfoo &AMP", "∉ ¬it; &foo &"),
    ("&lt;b&gt;", "<b>"),
    ("<![cdata[open", ""),
    ("", ""),
]


def convert(spark, texts, modern=True):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", html_to_text(F.col("t"), modern).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def test_rules(spark):
    assert convert(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]


def test_references_as_in_the_standard_library(spark):
    rng = random.Random(2)
    names = sorted(stdlib.entities.html5)
    texts = ["".join(rng.choice(["&" + rng.choice(names), " x", "&", ";", "abc", "&#6" + str(rng.randint(0, 9)) + ";"]) for _ in range(6)) for _ in range(400)]
    assert convert(spark, texts) == [stdlib.unescape(t) for t in texts]


def test_old_indexes_stop_at_the_first_name(spark):
    assert convert(spark, ["Fish &amp; Chips", "a&zzz;b", "<i>x</i>&#65;"], modern=False) == ["Fish &amp", "a&zzz;b", "xA"]
