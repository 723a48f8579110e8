"""HTML to text by regular expressions and one pass over tokens.

Comments, tags, doctypes, processing instructions and CDATA sections vanish without a separator; the contents of script and
style stay, as does what looks like markup but isn't. A comment ends at its first >. A NUL ends the document.
Character references are decoded: decimal and hexadecimal ones if they name a character, named ones by the longest name of
HTML 5 (modern=True), or, for reading old indexes, by the shortest name, after which the document ends in that name.
"""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKUP = r"<!--[^>]*+>?|(?i:<!\[cdata\[)(?>(?s:.*?)(?:\]\]|\z))|<\?[^>]*+>?|(?i:<!doctype)[^>]*+>?|</?[A-Za-z][^>]*+>?|\x00(?s:.*+)"
REFERENCE = r"&(?:#[0-9]++;?|#[Xx][0-9A-Fa-f]++;?|[A-Za-z0-9]++;?)"
PLAIN = r"[^<&\x00]++|[<&]"


@cache
def _tables() -> tuple[str, str, str]:
    """Names to characters as JSON; names that need no semicolon, longest first; names no other name is a prefix of."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    shortest: list[str] = []
    for n in sorted(html5):
        if not any(n.startswith(s) for s in shortest[-1:]):
            shortest.append(n)
    return json.dumps(html5), "|".join(bare), "|".join(shortest)


def _character(code: Column) -> Column:
    """The character of a code point, or null."""
    valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _decoded(token: Column) -> Column:
    names_json, bare, _ = _tables()
    names = F.from_json(F.lit(names_json), "map<string,string>")
    digits = F.regexp_extract(token, "^&#[Xx]?([0-9A-Fa-f]+);?$", 1)
    short = F.regexp_replace(digits, "^0+(?=.)", "")  # so that any number of zeros may lead
    code = F.when(token.rlike("^&#[Xx]"), F.when(F.length(short) <= 8, F.conv(short, 16, 10))).otherwise(F.when(F.length(short) <= 9, short)).try_cast("long")
    name = F.substring(token, 2, 64)
    prefix = F.regexp_extract(token, f"^&({bare})", 1)
    legacy = F.when(prefix != "", F.concat(F.try_element_at(names, prefix), F.substr(token, F.length(prefix) + 2)))
    return (
        F.when(token.rlike("^&#"), F.coalesce(_character(code), token))
        .when(token.rlike("^&[A-Za-z0-9]"), F.coalesce(F.try_element_at(names, name), legacy, token))
        .otherwise(token)
    )


def _cut_short(token: Column, shortest: str) -> Column:
    """A resolvable name gives its character, then the bare name, and nothing more."""
    names = F.from_json(F.lit(_tables()[0]), "map<string,string>")
    name = F.regexp_extract(token, f"^&({shortest})", 1)
    return F.when(name != "", F.concat(F.try_element_at(names, name), name))


def html_to_text(html: Column, modern: bool = True) -> Column:
    is_markup = lambda t: t.rlike(f"^(?:{MARKUP})")
    if modern:
        tokens = F.regexp_extract_all(html, F.lit(f"{MARKUP}|{REFERENCE}|{PLAIN}"), F.lit(0))
        kept = F.filter(tokens, lambda t: ~is_markup(t))
        return F.array_join(F.transform(kept, lambda t: F.when(t.startswith("&"), _decoded(t)).otherwise(t)), "")
    shortest = _tables()[2]
    ending = f"&(?:{shortest})(?s:.*+)"
    tokens = F.regexp_extract_all(html, F.lit(f"{ending}|{MARKUP}|{REFERENCE}|{PLAIN}"), F.lit(0))
    kept = F.filter(tokens, lambda t: ~is_markup(t))
    return F.array_join(F.transform(kept, lambda t: F.when(t.startswith("&"), F.coalesce(_cut_short(t, shortest), _decoded(t))).otherwise(t)), "")
