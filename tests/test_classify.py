import pytest
from pyspark.sql import functions as F

from foliant.functions.classify import content_kind, file_kind, lossy_text, name_kind

NAMES = {"a/B.PDF": "ignore", "thumbs.DB": "ignore", "x/stored.idx": "ignore", "notes": "inspect", "x.html": "inspect", "y.txt": "inspect", ".pdf": "inspect", "a.pdf/b": "inspect", "history.txt": "ignore"}
CONTENTS = [
    (b"<!DOCTYPE html>x", "html"),
    (b"  \n<html>", "html"),
    (b"<Html>", "text"),
    (b"\x01abc", "ignore"),
    (b"", "text"),
    (b" \t\r\n", "text"),
    (b"\xef\xbb\xbf<html>", "text"),
    (b"x" * 256 + b"\x00", "text"),
    (b"tab\tand\rline\n", "text"),
]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    assert {r[0]: r[1] for r in df.select("n", name_kind(F.col("n"))).collect()} == NAMES


@pytest.mark.parametrize(("content", "kind"), CONTENTS)
def test_contents(spark, content, kind):
    df = spark.createDataFrame([("a.txt", bytearray(content))], "n string, c binary")
    assert df.select(content_kind(F.col("c")), file_kind(F.col("n"), F.col("c"))).first() == (kind, kind)


def test_lossy(spark):
    assert spark.createDataFrame([(bytearray(b"a\xffb\xc3\xa9"),)], "c binary").select(lossy_text(F.col("c"))).first()[0] == "a�bé"
