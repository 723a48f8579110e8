"""Glob patterns as SQL predicates: * is any run of characters, ? exactly one, all else is itself. Case counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_pattern(glob: str) -> str:
    """The LIKE pattern of a glob, escaped by backslashes."""
    return "".join("%" if c == "*" else "_" if c == "?" else f"\\{c}" if c in "%_\\" else c for c in glob)


def matches(value: Column, glob: str) -> Column:
    """value matches the glob. Globs without wildcards are equalities, abc* a prefix test: both reach the Parquet scan."""
    if not set(glob) & set("*?"):
        return value == glob
    return value.like(like_pattern(glob))


def matches_any(value: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for glob in globs:
        found = found | matches(value, glob)
    return found


def like_sql(value: str, glob: str) -> str:
    """The same predicate in SQL text."""
    quoted = like_pattern(glob).replace("'", "''")
    return f"{value} LIKE '{quoted}' ESCAPE '\\'" if set(glob) & set("*?") else f"{value} = '{glob.replace(chr(39), chr(39) * 2)}'"
