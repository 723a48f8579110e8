"""From globs to words, and from words to a filter that reaches the scan of postings.

A glob with a fixed beginning is a range of sorted words, which the scan of postings knows how to skip to. One without (*ation, ?e*) is looked
up in the dictionary first: runs that merges wrote have a table of the pieces (grams) of their words, three characters each and the
two at either end, sorted by piece; words that have all pieces of a glob are candidates, which the glob itself then decides on. Other runs
are of level 0, and few: their words are read, without lists. If no more than LISTED words are found, they become equalities, which skip
row groups; with more of them few row groups could be skipped, and the glob is applied to all postings.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from foliant.functions.globs import matches

if TYPE_CHECKING:
    from .index import Snapshot

GRAMS = "gram string, word string"
GRAM = 3
PIECES_A_TASK = 500_000  # that a task sorts
LISTED = 512  # words that become equalities
FIRST, LAST = "^", "$"  # no words contain them


def grams_of(word: Column) -> Column:
    """The pieces of a word, with marks at its ends."""
    marked = F.concat(F.lit(FIRST), word, F.lit(LAST))
    inner = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(marked) - (GRAM - 1), F.lit(1))), lambda i: F.substring(marked, i, F.lit(GRAM)))
    return F.array_distinct(F.concat(inner, F.array(F.substring(marked, 1, 2), F.substring(marked, -2, 2))))


def grams_of_glob(glob: str) -> list[str]:
    """The pieces that every word has which the glob matches."""
    out = set()
    for piece in (FIRST + glob + LAST).replace("?", "*").split("*"):
        out.update(piece[i : i + GRAM] for i in range(len(piece) - GRAM + 1))
        if len(piece) == 2 and (piece[0] == FIRST or piece[1] == LAST):
            out.add(piece)
    return sorted(out)


def write_grams(words: DataFrame, path: str, row_group: int, staging: str) -> None:
    """The pieces of a run's words, which are staged: as many words go to a task as have the pieces that one sorts, for the writer of a shuffle
    into many ranges holds all that is made of its share."""
    seen = Observation()
    words.observe(seen, F.coalesce(F.sum(F.char_length("word") + 2), F.lit(0)).alias("n")).write.parquet(staging)
    n = -(-seen.get["n"] // PIECES_A_TASK) or 1  # pieces, at most
    dealt = words.sparkSession.read.schema(words.schema).parquet(staging).repartition(n, "word")
    pieces = dealt.select(grams_of(F.col("word")).alias("grams"), "word").select(F.explode_outer("grams").alias("gram"), "word")  # none is empty, which a filter would look into
    pieces.repartitionByRange(n, "gram", "word").sortWithinPartitions("gram", "word").write.option("parquet.block.size", row_group).parquet(path)


def any_of(column: Column, values: list[str]) -> Column:
    """column is one of the values, as a balanced tree of equalities: unlike IN, all of them reach the scan."""
    parts = [column == v for v in values]
    while len(parts) > 1:
        parts = [a | b for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    return parts[0] if parts else F.lit(False)


def found_words(snapshot: Snapshot, glob: str) -> DataFrame:
    """word: the words of all runs that a glob matches; perhaps some of files that were deleted."""
    pieces = grams_of_glob(glob)
    runs = [r for r in snapshot.runs if r.n_files]
    indexed = [r for r in runs if r.grams] if pieces else []
    plain = [r for r in runs if r not in indexed]
    found = snapshot.dictionary_rows(plain).select("word").where(matches(F.col("word"), glob))
    if indexed:
        table = snapshot.table("grams", GRAMS, indexed).where(any_of(F.col("gram"), pieces))
        some = table.groupBy("word").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(pieces))
        found = found.union(some.select("word").where(matches(F.col("word"), glob)))
    return found.distinct()


def has_beginning(glob: str) -> bool:
    return glob[:1] not in ("*", "?", "")


def words_filter(snapshot: Snapshot, globs: list[str]) -> Column:
    """Of the column word of postings, whether any glob matches; in a form that lets the scan skip row groups where that is possible."""
    word, parts = F.col("word"), []
    for glob in globs:
        if has_beginning(glob):
            parts.append(matches(word, glob))
            continue
        words = [r["word"] for r in found_words(snapshot, glob).limit(LISTED + 1).collect()]
        parts.append(any_of(word, sorted(words)) if len(words) <= LISTED else matches(word, glob))
    return reduce(or_, parts, F.lit(False))
