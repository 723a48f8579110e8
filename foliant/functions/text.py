"""Text to words, as one regular expression over the whole text.

After a line break, four kinds of blocks are dropped: PGP signatures, uuencoded blocks, blocks between BEGIN and END, and header
lines. Short tags are dropped where the scanner stands on one. What is left are maximal runs of alphabetic characters.
Every alternative is possessive and together they match anything, so matches follow one another without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_A = r"a-zA-Z\p{IsAlphabetic}"  # within brackets; most letters are told by the two ranges, without a look at a table
_W = r"\p{IsWhite_Space}"
_DASHES = "-----"
# Blocks that start a line.
SIGNATURE = rf"{_DASHES}BEGIN PGP SIGNATURE{_DASHES}[^\n]*+[\n\r](?>(?s:.*?){_DASHES})END PGP SIGNATURE{_DASHES}[^\n]*+"
UUENCODED = rf"begin[^\n]*+(?:[\n\r](?!`(?:\n|\z)){_W}*+[^\n]++)*+[\n\r]`{_W}*+end[^\n]*+"
ENCODED = rf"BEGIN[^\n]*+(?:[\n\r](?!END){_W}*+[^\n]++)*+[\n\r]END[^\n]*+"
HEADER = r"[A-Za-z0-9*-]*+:[^\n]*+"
TAG = "<[^>]{1,20}+>"
# Words come first, as most matches are words; nothing else starts with a letter.
TOKENS = rf"([{_A}]++)[^{_A}\n]*+|[\n\r]{_W}*+(?:{SIGNATURE}|{UUENCODED}|{ENCODED}|{HEADER})|{TAG}|[^{_A}\n]++|[\n\r]"
# Every text is covered by matches of TOKENS; group 1 holds the word, if the match is one.


def matched(text: Column) -> Column:
    """All words of a text, in order, as they are written, and an empty string for each match between them."""
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(1))


def words(text: Column) -> Column:
    """All words of a text, in order, as they are written."""
    return F.filter(matched(text), lambda w: w != "")


def term(word: Column) -> Column:
    """The form of a word in the index."""
    return F.lower(word)


def cut_term(word: Column, size: int = 20) -> Column:
    """Words of so many bytes of UTF-8 or more are cut to that, less a character of several bytes at the cut, even a whole one."""
    cut = F.regexp_replace(F.hex(F.substring(word.cast("binary"), 1, size)), "(?:[C-F][0-9A-F])?(?:[89AB][0-9A-F])*$", "")
    return F.when(F.octet_length(word) < size, word).otherwise(F.decode(F.unhex(cut), "UTF-8"))
