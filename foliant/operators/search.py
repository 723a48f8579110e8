"""Searching: files that have a word for every glob, and their lines that match any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.globs import matches, matches_any


def find_ids(postings: DataFrame, globs: list[str]) -> DataFrame:
    """file_id of files in which every glob matches some word. One filter that reaches the scan, one aggregate with a bit a glob.

    Sets of more than 63 globs are split over several longs.
    """
    word = F.col("word")
    chunks = [globs[i : i + 63] for i in range(0, len(globs), 63)]
    bits = [sum((F.when(matches(word, g), F.lit(1 << i)).otherwise(F.lit(0)) for i, g in enumerate(part)), F.lit(0)).cast("long") for part in chunks]
    masks = [F.bit_or(b).alias(f"_m{k}") for k, b in enumerate(bits)]
    if not globs:
        return postings.where(F.lit(False)).select("file_id")
    whole = F.lit(True)
    for k, part in enumerate(chunks):
        whole = whole & (F.col(f"_m{k}") == F.lit((1 << len(part)) - 1))
    return postings.where(matches_any(word, globs)).groupBy("file_id").agg(*masks).where(whole).select("file_id")


def find(postings: DataFrame, files: DataFrame, globs: list[str]) -> DataFrame:
    """file_id, name of the files found; ids without a file are dropped. Order by file_id to page through them."""
    return files.join(find_ids(postings, globs), "file_id").select("file_id", "name")


def matched_lines(text: Column, globs: list[str]) -> Column:
    """Lines that have a token, cut at spaces and taken as it is, that any glob matches. Of a null text, none."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.exists(F.split(line, " "), lambda w: matches_any(w, globs)))
    return F.coalesce(lines, F.array().cast("array<string>"))


def find_with_lines(postings: DataFrame, files: DataFrame, texts: DataFrame, globs: list[str]) -> DataFrame:
    """file_id, name, lines; files without matching lines, or that have vanished, stay with none. texts: file_id, text."""
    found = find(postings, files, globs)
    return found.join(texts.select("file_id", "text"), "file_id", "left").select("file_id", "name", matched_lines(F.col("text"), globs).alias("lines"))


def find_files(files: DataFrame, glob: str) -> DataFrame:
    """file_id, name of files whose name matches."""
    return files.where(matches(F.col("name"), glob)).select("file_id", "name")


def page(found: DataFrame, number: int, size: int = 20) -> DataFrame:
    """A page of results, from 0 on, in the order of file_id; a bounded top-k, no full sort."""
    ordered = found.orderBy("file_id")
    return (ordered.offset(number * size) if number else ordered).limit(size)


def page_after(found: DataFrame, last: int | None, size: int = 20) -> DataFrame:
    """The page of results that follows a file_id: a filter and a bounded top-k, whatever came before it. found is read in the order of file_id."""
    rest = found if last is None else found.where(F.col("file_id") > F.lit(last))
    return rest.orderBy("file_id").limit(size)


def new_files(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files whose names aren't in the catalogue."""
    return listed.join(files.select("name"), "name", "left_anti")


class Pager:
    """The cursor of a prompt over results, which are kept as a table, so that a page neither searches again nor counts from the start.

    show gets the rows of a page (file_id, name; at most size) and gives what is to be shown of them, such as their lines; so
    nothing is opened for results that nobody has asked for. Without a folder to keep results in, each page asks found anew.
    """

    def __init__(self, found: DataFrame, size: int = 20, folder: str | None = None, show: Callable[[DataFrame], DataFrame] | None = None):
        self.size, self.at, self.last, self.total, self.show = size, 0, None, None, show
        if folder:
            where = f"{folder}/{uuid.uuid4().hex}"
            found.repartitionByRange("file_id").sortWithinPartitions("file_id").write.parquet(where)
            found = found.sparkSession.read.schema(found.schema).parquet(where)
        self.found = found

    def _next(self) -> list:
        if self.total is None:
            self.total = self.found.count()
        some = page_after(self.found, self.last, self.size)
        rows = some.collect()
        if rows:
            self.last = rows[-1]["file_id"]
        self.at += 1
        if self.show and rows:
            some = some.sparkSession.createDataFrame(rows, some.schema)  # size rows at most
            rows = self.show(some).orderBy("file_id").collect()
        return rows

    def first(self) -> list:
        self.at, self.last = 0, None
        return self._next()

    def next(self) -> list:
        return self._next()

    @property
    def has_more(self) -> bool:
        return self.total is not None and self.at * self.size < self.total
