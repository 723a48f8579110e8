import pytest
from pyspark.sql import functions as F

#: Awkward rows: nulls, empties, ties, repeated rows, very long texts, and other columns with names that operators use.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog", "a"),
    (2, "the quick  brown fox\njumps over the lazy dog", "a"),
    (3, "", "a"),
    (4, None, "b"),
    (5, " \t\n", None),
    (6, "word " * 30000, "b"),
    (7, "The quick brown fox jumps over the lazy dog", None),
    (7, "The quick brown fox jumps over the lazy dog", None),
    (None, "The quick brown fox jumps over the lazy dog", "a"),
    (8, "x", "a"),
    (9, "naïve café ▁ 日本 🙂 tab\there\r\n", "c"),
    (10, "9" * 20000 + " " + "a" * 20000 + "@", "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, s, "en", 0, "clash", 1, True, 2.0) for i, t, s in TEXTS]
    schema = "doc_id long, text string, source string, lang string, n_chars long, key string, size long, kept boolean, score double"
    return spark.createDataFrame(rows, schema).repartition(3)


#: Names that operators use for columns of their own.
INNER = (
    "_key _sha _size _keep _src _doc _position _gone _last _salt _n _at _b _k _hot _cold _found _probe _number _entry bucket key chain keep_id group_size n norm row rep comp hub "
    "component_id kept n_shingles f1 f2 sketch keys band src size words block at due positions target source_size ramp label held_out score predicted media feature spans start id"
).split()


@pytest.fixture(scope="session")
def clashing(awkward):
    """Awkward rows with a column of each such name."""
    plain = awkward.select("doc_id", "text", "source", "lang", "n_chars")
    return plain.select("*", *[F.lit(f"mine {n}").alias(n) for n in INNER])


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
