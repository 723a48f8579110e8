"""What a file is: by its name, ignored or to be inspected; by its first bytes, html, text, or ignored as binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and names of files that aren't indexed, and how HTML starts.
IGNORED_EXTENSIONS = (
    "jpg", "pdf", "gif", "css", "png", "doc", "rtf", "js", "ico", "woff", "zip", "jpeg", "odt",
    "docx", "lit", "xml", "epub", "mobi", "exe", "mp3", "azw3", "bmp", "bak", "ccs",
    "dwt", "eot", "img", "pdb", "prc", "psc", "swf", "svg", "wmf", "wpd", "wav", "mso", "mid",
    "thmx", "zblorb", "rm", "ttf", "woff2", "emz", "mht",
)
IGNORED_NAMES = (".message.ftp.txt", "history.txt", "stored.idx", "log.txt", "thumbs.db")
HTML_STARTS = ("<!--ADULTSONLY", "<--", "<head", "<HTML", "<html", "<?xml", "<!DOCTYPE", "<!doctype", "_<!DOCTYPE")
SNIFFED = 256  # bytes


def base_name(name: Column) -> Column:
    return F.regexp_extract(name, "([^/]*)$", 1)


def extension(name: Column) -> Column:
    """What follows the last dot of the base name, in lower case; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(base_name(name), r"^.+\.([^.]*)$", 1))


def is_ignored_name(name: Column) -> Column:
    return extension(name).isin(*IGNORED_EXTENSIONS) | F.lower(base_name(name)).isin(*IGNORED_NAMES)


def name_kind(name: Column) -> Column:
    return F.when(is_ignored_name(name), F.lit("ignore")).otherwise(F.lit("inspect"))


def content_kind(content: Column) -> Column:
    """From the bytes of a file."""
    head = F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1")
    trimmed = F.regexp_replace(head, "^[ \t\n\r]+", "")
    html = F.lit(False)
    for start in HTML_STARTS:
        html = html | trimmed.startswith(start)
    return F.when(html, F.lit("html")).when(trimmed.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit("ignore")).otherwise(F.lit("text"))


def file_kind(name: Column, content: Column) -> Column:
    return F.when(is_ignored_name(name), F.lit("ignore")).otherwise(content_kind(content))


def lossy_text(content: Column) -> Column:
    """UTF-8 with a replacement character for what isn't."""
    return F.make_valid_utf8(content.cast("string"))
