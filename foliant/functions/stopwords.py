"""Stop words. A list is a parameter of everything that drops them.

The list of an index is given as a file (read_list), either to the functions and the Engine or, for all of a process, by the
environment variable FOLIANT_STOP_WORDS. Without one, the lists that Spark ML ships for some languages and the single
letters are taken. Only words that the tokenizer can produce matter, so entries with other than letters are left out.
"""

from __future__ import annotations

import os
import string
import zipfile
from collections.abc import Iterable
from functools import cache
from pathlib import Path

import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("english", "german", "french")
GIVEN = "FOLIANT_STOP_WORDS"


def usable(words: Iterable[str]) -> tuple[str, ...]:
    return tuple(sorted({w for w in (x.strip().lower() for x in words) if w.isalpha()}))


@cache
def shipped_list(languages: tuple[str, ...] = LANGUAGES) -> tuple[str, ...]:
    """The lists in Spark ML's jar, and the letters a to z."""
    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    for jar in (j for home in homes if home for j in sorted(Path(home, "jars").glob("spark-mllib_*.jar"))):
        with zipfile.ZipFile(jar) as z:
            lists = [z.read(f"org/apache/spark/ml/feature/stopwords/{x}.txt").decode().splitlines() for x in languages]
        return usable([*(w for words in lists for w in words), *string.ascii_lowercase])
    raise FileNotFoundError(f"Spark ML isn't installed here: name a file of stop words in {GIVEN}")


def default_list() -> tuple[str, ...]:
    path = os.environ.get(GIVEN)
    return read_list(path) if path else shipped_list()


@cache
def read_list(path: str) -> tuple[str, ...]:
    """One word a line. Quotes around it and a comma after it don't count, so lists out of source texts can be read as they are."""
    return usable(line.strip().rstrip(",").strip("\"'") for line in Path(path).read_text(encoding="utf-8").splitlines())


def stop_words_sql(stop_words: Iterable[str] | None = None) -> str:
    """The words as the inside of an IN list; they are letters only."""
    return ", ".join(f"'{w}'" for w in (default_list() if stop_words is None else usable(stop_words))) or "''"


def is_stop_word(term: str, stop_words: Iterable[str] | None = None) -> Column:
    """Of a column, by its name, or of a lambda's variable. A test by a hash set inside generated code; no join, no broadcast."""
    return F.expr(f"{term} IN ({stop_words_sql(stop_words)})")
