"""The engine's registered queries, by name, and their SQL counterparts. Every query runs over whole tables."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.cli import Prompt
from foliant.functions.classify import HTML_STARTS, IGNORED_EXTENSIONS, IGNORED_NAMES, content_kind, lossy_text, name_kind
from foliant.functions.globs import like_sql
from foliant.functions.html import html_to_text
from foliant.functions.stopwords import is_stop_word, stop_words_sql
from foliant.functions.text import cut_term, words
from foliant.operators import search, stats, tokens
from foliant.operators.index import Index
from foliant.plans.engine import Engine
from foliant.sources import files as file_source
from foliant.sources import tables
from foliant.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# SQL: the tokenizer in RE2's syntax, stop words, and the tables that the queries share.
SQL_TOKENS = r"[\n\r]\s*[A-Za-z0-9*-]*:[^\n]*|<[^>]{1,20}>|(\p{L}+)[^\p{L}\n]*|[^\p{L}\n]+|[\n\r]"
SQL_MARKUP = r"<!--[^>]*>?|(?i:<!\[cdata\[)(?s:.*?)(?:\]\]|\z)|<\?[^>]*>?|(?i:<!doctype)[^>]*>?|</?[A-Za-z][^>]*>?"
STOP_SQL = "<stop words>"  # the list is read when SQL is asked for, not when this module is imported
REFERENCES = (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _words_sql(table: str, file_id: str, text: str) -> str:
    return f"SELECT file_id, w AS word FROM (SELECT {file_id} AS file_id, unnest(regexp_extract_all({text}, '{SQL_TOKENS}', 1)) AS w FROM {table}) WHERE w <> ''"


def _html_sql(html: str = "html") -> str:
    # references cut off before markup get their semicolon first: none may arise from what stands around markup
    out = rf"regexp_replace({html}, '&(quot|middot|copy|lt|gt|amp)(<|$)', '&\1;\2', 'g')"
    out = f"regexp_replace({out}, '{SQL_MARKUP}', '', 'g')"
    for name, char in REFERENCES:
        out = f"replace({out}, '{name}', '{char}')"
    return out


def _with(table: str = "documents", file_id: str = "doc_id", text: str = "text", name: str = "'doc/' || doc_id || '.txt'") -> str:
    return f"""WITH raw AS ({_words_sql(table, file_id, text)}),
every AS (SELECT file_id, lower(word) AS word FROM raw),
terms AS (SELECT * FROM every WHERE word NOT IN ({STOP_SQL})),
tf AS (SELECT file_id, word, count(*) AS tf FROM terms GROUP BY ALL),
words AS (SELECT word, sum(tf)::BIGINT AS count, count(*) AS df FROM tf GROUP BY word),
files AS (SELECT {file_id} AS file_id, {name} AS name FROM {table})
"""


DOCS = _with()
PAGES = _with("pages", "page_id", _html_sql(), "url")
TALKS = _with("conversations", "(conv_id * 1048576 + turn)", "text", "'conversation/' || conv_id || '/' || turn || '.txt'")
ITEMS = _with("benchmark", "item_id", "text", "'benchmark/' || item_id || '.txt'")


def oracles() -> dict[str, str]:
    """The SQL of each query that has any."""
    listed = stop_words_sql()
    return {name: sql.replace(STOP_SQL, listed) for name, sql in ORACLES.items()}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _tf(spark: SparkSession, d: str) -> DataFrame:
    return tokens.term_frequencies(tables.documents(spark, d))


# Tokens and terms.


@query("tokens_txt", DOCS + "SELECT file_id, word FROM raw")
def tokens_txt(spark, d):
    return tokens.raw_words(tables.documents(spark, d))


@query("tokens_nonstop", DOCS + "SELECT file_id, word FROM terms")
def tokens_nonstop(spark, d):
    return tokens.terms(tables.documents(spark, d))


@query("stop_word_hits", DOCS + f"SELECT word, count(*) AS hits FROM every WHERE word IN ({STOP_SQL}) GROUP BY word")
def stop_word_hits(spark, d):
    return tokens.all_terms(tables.documents(spark, d)).where(is_stop_word("word")).groupBy("word").agg(F.count(F.lit(1)).alias("hits"))


@query("term_freq", DOCS + "SELECT file_id, word, tf FROM tf")
def term_freq(spark, d):
    return _tf(spark, d)


@query(
    "doc_token_count",
    DOCS + "SELECT f.file_id, count(e.word) FILTER (e.word NOT IN (" + STOP_SQL + ")) AS token_count, count(e.word) AS n_words FROM files f LEFT JOIN every e USING (file_id) GROUP BY f.file_id",
)
def doc_token_count(spark, d):
    return tokens.token_counts(tables.documents(spark, d))


BYTES = "octet_length(encode({}))".format


@query(
    "truncate_term",
    DOCS.rstrip()
    + f""", fits AS (SELECT word, list_max(list_filter(range(1, length(word) + 1), lambda i: {BYTES("left(word, i)")} <= 20)) AS k FROM words)
SELECT word, CASE WHEN {BYTES("word")} < 20 THEN word WHEN {BYTES("left(word, k)")} = 20 AND {BYTES("right(left(word, k), 1)")} > 1 THEN left(word, k - 1) ELSE left(word, k) END AS cut FROM fits""",
)
def truncate_term(spark, d):
    return stats.word_stats(_tf(spark, d)).select("word", cut_term(F.col("word")).alias("cut"))


# The dictionary.


@query("word_stats", DOCS + "SELECT word, count, df FROM words")
def word_stats(spark, d):
    return stats.word_stats(_tf(spark, d))


@query("postings", DOCS + "SELECT DISTINCT word, file_id FROM terms")
def postings(spark, d):
    return _tf(spark, d).select("word", "file_id")


@query("total_words", DOCS + "SELECT count(*) AS total FROM terms")
def total_words(spark, d):
    return stats.total_words(_tf(spark, d))


BAGS = "SELECT word, count, df, least(255, (count * 5120) // (SELECT sum(count) FROM words))::INT AS freq_bag FROM words"


@query("freq_bag", DOCS + BAGS)
def freq_bag(spark, d):
    return stats.frequency_bags(stats.word_stats(_tf(spark, d)))


@query("bag_histogram", DOCS + f"SELECT freq_bag, count(*) AS n_words FROM ({BAGS}) GROUP BY freq_bag")
def bag_histogram(spark, d):
    return stats.bag_histogram(freq_bag(spark, d))


@query("invert_tf", DOCS + "SELECT file_id, tf, array_to_string(list_sort(list(word)), ' ') AS words FROM tf GROUP BY file_id, tf")
def invert_tf(spark, d):
    return stats.inverted_frequencies(_tf(spark, d)).withColumn("words", F.array_join("words", " "))


@query(
    "df_histogram_cum",
    DOCS + "SELECT df, n_words, sum(n_words) OVER (ORDER BY df) * 100.0::DOUBLE / sum(n_words) OVER () AS cum_percent FROM (SELECT df, count(*) AS n_words FROM words GROUP BY df)",
)
def df_histogram_cum(spark, d):
    return stats.df_histogram(stats.word_stats(_tf(spark, d)))


@query("rare_words", DOCS + "SELECT word, df FROM words WHERE df <= floor((SELECT count(*) FROM files) * 0.1::DOUBLE)")
def rare_words(spark, d):
    docs = tables.documents(spark, d)
    return stats.rare_words(stats.word_stats(_tf(spark, d)), docs.agg(F.count(F.lit(1)).alias("n")))


@query("index_stats", DOCS + "SELECT (SELECT count(*) FROM files) AS n_files, count(*) AS n_words, sum(count)::BIGINT AS n_tokens, sum(df)::BIGINT AS n_postings FROM words")
def index_stats(spark, d):
    return stats.index_stats(tables.documents(spark, d), stats.word_stats(_tf(spark, d)))


@query("posting_stats", DOCS + "SELECT count(*) AS df, coalesce(sum(tf), 0)::BIGINT AS count, min(file_id) AS first_file, max(file_id) AS last_file FROM tf WHERE word = 'token'")
def posting_stats(spark, d):
    return stats.posting_stats(_tf(spark, d), "token")


# Searching. A word's tf isn't needed here, so terms are filtered before they are counted.


def _found_sql(start: str, globs: list[str]) -> str:
    ids = " INTERSECT ".join(f"SELECT DISTINCT file_id FROM terms WHERE {like_sql('word', g)}" for g in globs)
    return start + f", found AS ({ids}) SELECT file_id, name FROM files JOIN found USING (file_id)"


def _search(name: str, globs: list[str], start: str = DOCS, source: Callable = tables.documents) -> None:
    @query(name, _found_sql(start.rstrip(), globs))
    def run(spark, d):
        texts = source(spark, d)
        return search.find(tokens.terms(texts), texts, globs)


_search("find_one", ["token"])
_search("find_prefix", ["th*"])
_search("find_suffix", ["*ing"])
_search("find_question", ["t??s", "e?a*"])
_search("find_and", ["th*", "*re"])
_search("find_and_three", ["th*", "*re", "*ing*"])
_search("find_no_hit_term", ["th*", "TH*"])
_search("page_find", ["th*", "*on"], PAGES, tables.pages)
_search("conversation_find", ["th*", "*on"], TALKS, tables.conversations)
_search("benchmark_find", ["*e*", "*t"], ITEMS, tables.benchmark)


def _lines_sql(globs: list[str], text: str = "text") -> str:
    some = " OR ".join(like_sql("w", g) for g in globs)
    return f"array_to_string(list_filter(string_split({text}, chr(10)), lambda l: len(list_filter(string_split(l, ' '), lambda w: {some})) > 0), chr(10))"


@query("matched_lines", f"SELECT doc_id AS file_id, {_lines_sql(['th*', '*re'])} AS lines FROM documents")
def matched_lines(spark, d):
    docs = tokens.spread(tables.documents(spark, d))
    return docs.select("file_id", F.array_join(search.matched_lines(F.col("text"), ["th*", "*re"]), "\n").alias("lines"))


@query(
    "find_with_lines",
    DOCS.rstrip()
    + f", found AS (SELECT file_id FROM terms WHERE word LIKE 'th%' INTERSECT SELECT file_id FROM terms WHERE word LIKE '%ing') SELECT file_id, name, {_lines_sql(['th*', '*ing'])} AS lines FROM files JOIN found USING (file_id) JOIN documents ON doc_id = file_id",
)
def find_with_lines(spark, d):
    docs = tables.documents(spark, d)
    found = search.find_with_lines(tokens.terms(docs), docs, docs, ["th*", "*ing"])
    return found.select("file_id", "name", F.array_join("lines", "\n").alias("lines"))


@query("find_files", f"SELECT page_id AS file_id, url AS name FROM pages WHERE {like_sql('url', '*1?/*')}")
def find_files(spark, d):
    return search.find_files(_page_names(spark, d), "*1?/*")


def _page_names(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("name"))


def _page_sql(offset: int) -> str:
    return _found_sql(DOCS.rstrip(), ["th*", "*re"]) + f" ORDER BY file_id LIMIT 20 OFFSET {offset}"


@query("page_first", _page_sql(0))
def page_first(spark, d):
    return search.page(QUERIES["find_and"](spark, d), 0)


@query("page_next", _page_sql(20))
def page_next(spark, d):
    return search.page(QUERIES["find_and"](spark, d), 1)


# Pages and files.


@query("html_text", f"SELECT page_id AS file_id, length(t) AS n_chars, md5(t) AS md5 FROM (SELECT page_id, {_html_sql()} AS t FROM pages)")
def html_text(spark, d):
    pages = tokens.spread(tables.read(spark, d, "pages").select("page_id", "html"))
    return pages.select(F.col("page_id").alias("file_id"), html_to_text(F.col("html")).alias("t")).select("file_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("md5"))


@query("page_term_freq", PAGES + "SELECT file_id, word, tf FROM tf")
def page_term_freq(spark, d):
    return tokens.term_frequencies(tables.pages(spark, d))


HEAD = r"regexp_replace(substr(t, 1, 256), '^[ \t\n\r]+', '')"
STARTS = " OR ".join(f"starts_with({HEAD}, '{s}')" for s in HTML_STARTS)
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


@query(
    "classify_content",
    f"""SELECT file_id, source_table, CASE WHEN {STARTS} THEN 'html' WHEN regexp_matches({HEAD}, '{CONTROL}') THEN 'ignore' ELSE 'text' END AS kind
FROM (SELECT doc_id AS file_id, 'documents' AS source_table, text AS t FROM documents UNION ALL SELECT page_id, 'pages', html FROM pages)""",
)
def classify_content(spark, d):
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit("documents").alias("source_table"), F.col("text").cast("binary").alias("content"))
    pages = tables.read(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.lit("pages").alias("source_table"), F.col("html").cast("binary").alias("content"))
    return docs.union(pages).select("file_id", "source_table", content_kind(F.col("content")).alias("kind"))


@query(
    "classify_name",
    f"""SELECT page_id AS file_id, CASE WHEN lower(regexp_extract(url, '[^/]*$')) IN ({", ".join(f"'{n}'" for n in IGNORED_NAMES)})
OR lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+\\.([^.]*)$', 1)) IN ({", ".join(f"'{e}'" for e in IGNORED_EXTENSIONS)}) THEN 'ignore' ELSE 'inspect' END AS kind FROM pages""",
)
def classify_name(spark, d):
    return _page_names(spark, d).select("file_id", name_kind(F.col("name")).alias("kind"))


@query("incremental_new_files", "SELECT name FROM (SELECT 'doc/' || doc_id || '.txt' AS name, doc_id FROM documents) WHERE name NOT IN (SELECT 'doc/' || doc_id || '.txt' FROM labels)")
def incremental_new_files(spark, d):
    """Documents with labels stand for the files that are indexed already."""
    indexed = tables.read(spark, d, "labels").select(F.format_string("doc/%d.txt", F.col("doc_id")).alias("name"))
    return search.new_files(tables.documents(spark, d), indexed).select("name")


# Rules that the tables never show: each row gets a construct by its id, put between two words of known effect.

RULES = (
    # what stands between, and what the rule leaves of it
    ("Subject: hi there\nnext", "next"),  # a header line
    ("  http://a.b/c d\nnext", "next"),
    (":gone with it\nnext", "next"),
    ("BEGIN k\nQUJD\nREVG\nEND k\nnext", "next"),
    ("begin 644 f\nM86\nM87\n`\nend\nnext", "next"),
    ("begin 644 f\nM86\nend\nnext", "begin f M end next"),  # no line that stops it
    ("-----BEGIN PGP SIGNATURE-----\niQ ab\n-----END PGP SIGNATURE-----\nnext", "next"),
    ("-----BEGIN PGP SIGNATURE-----\niQ\n------END PGP SIGNATURE-----\nnext", "BEGIN PGP SIGNATURE iQ END PGP SIGNATURE next"),
    ("<i><b>next", "next"),  # tags at the start of a line
    ("<aaaaaaaaaaaaaaaaaaaaa>next", "aaaaaaaaaaaaaaaaaaaaa next"),  # too long for a tag
    ("word <b>next</b>", "word b next b"),  # a tag after a word is none
    ("don't 42 abc123def", "don t abc def"),
    ("a\rKey: v", "a Key v"),  # the break is swallowed with what isn't a letter
)
MARKUP_RULES = (
    ("<![CDATA[gone]]>", ">"),
    ("<![cdata[gone > gone]]", ""),
    ("<?php gone ?>", ""),
    ("<!DocType gone>", ""),
    ("<!-- gone > kept -->", " kept -->"),
    ("a < b & c", "a < b & c"),
    ("</ FONT>", "</ FONT>"),
    ("<b title='x > y'>z", " y'>z"),
    ("<script>var t=1;</script>", "var t=1;"),
    ("&#65;&#x42;&#67", "ABC"),
    ("&#55296;&#1114112;&#;", "&#55296;&#1114112;&#;"),
    ("&#x1F600;&#128512;", "😀😀"),
    ("&#00000000065;&#99999999999999999999;", "A&#99999999999999999999;"),
    ("&zzz; &notin; &ampfoo &copy;", "&zzz; ∉ &foo ©"),
)
ENDS = (("\0 lost", ""), ("<br lost", ""), ("<!-- lost", ""), ("<![CDATA[lost", ""), ("&#66", "B"))  # of a document


def _quoted(s: str) -> str:
    """A text in SQL; control characters and line breaks can't stand there as they are."""
    plain = "".join(f"' || chr({ord(c)}) || '" if c < " " else c.replace("'", "''") for c in s)
    return f"('{plain}')"


def _cases_sql(cases: tuple, of: str, which: int) -> str:
    return f"[{', '.join(_quoted(c[which]) for c in cases)}][(({of}) % {len(cases)} + 1)::INT]"


def _case(cases: tuple, of: str, which: int = 0) -> Column:
    return F.element_at(F.array(*[F.lit(c[which]) for c in cases]), (F.expr(of) % len(cases) + 1).cast("int"))


@query(
    "block_rules",
    "WITH x AS (SELECT doc_id AS file_id, regexp_extract_all(coalesce(text, ''), '[a-z]+') AS w FROM documents) "
    f"SELECT file_id, trim(array_to_string(w, ' ') || ' ' || {_cases_sql(RULES, 'file_id', 1)}) AS words FROM x",
)
def block_rules(spark, d):
    """Words of a document's plain letters, a line break and a construct."""
    docs = tokens.spread(tables.read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("text")))
    plain = F.array_join(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)), " ")
    return docs.select("file_id", F.array_join(words(F.concat(plain, F.lit("\n"), _case(RULES, "file_id"))), " ").alias("words"))


@query(
    "markup_rules",
    "WITH x AS (SELECT page_id, array_to_string(regexp_extract_all(coalesce(html, ''), '[a-z]+'), ' ') AS t FROM pages) "
    f"SELECT page_id AS file_id, t || {_cases_sql(MARKUP_RULES, 'page_id', 1)} || t || {_cases_sql(ENDS, 'page_id // 7', 1)} AS text FROM x",
)
def markup_rules(spark, d):
    """The text of a page whose plain letters stand around a construct, and that ends in another."""
    pages = tokens.spread(tables.read(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html")))
    plain = F.array_join(F.regexp_extract_all("html", F.lit("[a-z]+"), F.lit(0)), " ")
    html = F.concat(plain, _case(MARKUP_RULES, "page_id"), plain, _case(ENDS, "page_id div 7"))
    return pages.select(F.col("page_id").alias("file_id"), html_to_text(html).alias("text"))


@query("lossy_text", "SELECT doc_id AS file_id, md5('é' || coalesce(text, '') || chr(65533) || 'x' || chr(65533) || chr(65533)) AS md5 FROM documents")
def lossy_utf8(spark, d):
    """Texts read from bytes that aren't all UTF-8."""
    docs = tokens.spread(tables.read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).cast("binary").alias("b")))
    content = F.concat(F.unhex(F.lit("C3A9")), "b", F.unhex(F.lit("FF78C3FF")))
    return docs.select("file_id", F.md5(lossy_text(content)).alias("md5"))


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return f"{shared.rstrip('/')}/foliant-{uuid.uuid4().hex}"


# The index: written to a folder of its own and read again.


def _indexed(spark: SparkSession, d: str) -> Engine:
    engine = Engine(spark, f"{_folder(spark)}/index")
    engine.add(tables.documents(spark, d))
    return engine


@query("stream_index", DOCS + "SELECT word, file_id, tf FROM tf")
def stream_index(spark, d):
    """Postings of an index that a stream over the documents, dealt over six files, has built in three micro-batches."""
    path = _folder(spark)
    tables.read(spark, d, "documents").select("doc_id", "text").repartition(6, "doc_id").write.parquet(f"{path}/documents")
    index = Index(spark, f"{path}/index")
    incremental.index_rows(index, incremental.document_stream(spark, f"{path}/documents", 2), f"{path}/checkpoint")
    return index.postings


@query("index_find", _found_sql(DOCS.rstrip(), ["th*", "*re"]))
def index_find(spark, d):
    """The same search over an index that is written and read again."""
    return _indexed(spark, d).find("th*", "*re")


GONE = like_sql("name", "doc/1*")


@query("delete_files", DOCS + f"SELECT word, count(*) AS df FROM tf WHERE file_id NOT IN (SELECT file_id FROM files WHERE {GONE}) GROUP BY word")
def delete_files(spark, d):
    """The dictionary after files were deleted from an index."""
    engine = _indexed(spark, d)
    engine.delete("doc/1*")
    return engine.index_.words.select("word", "df")


@query("compacted_index", DOCS + f"SELECT word, file_id, tf FROM tf WHERE file_id NOT IN (SELECT file_id FROM files WHERE {GONE})")
def compacted_index(spark, d):
    """Postings after files were deleted and the index was compacted in place."""
    engine = _indexed(spark, d)
    engine.delete("doc/1*")
    return engine.save().index_.postings


@query(
    "index_catalogue",
    DOCS.rstrip()
    + ", n AS (SELECT file_id, sum(tf)::BIGINT AS n FROM tf GROUP BY file_id) SELECT file_id, name, 'text' AS kind, coalesce(n, 0) AS token_count, (SELECT max(file_id) FROM files) AS last_id FROM files LEFT JOIN n USING (file_id)",
)
def index_catalogue(spark, d):
    engine = _indexed(spark, d)
    return engine.files().withColumn("last_id", F.lit(engine.last_id()).cast("long"))


@query("index_words", DOCS + BAGS)
def index_words(spark, d):
    return _indexed(spark, d).words()


@query("index_lookups", DOCS + "SELECT f.file_id, f.name, t.tf FROM files f JOIN tf t USING (file_id) WHERE t.word = 'token'")
def index_lookups(spark, d):
    """Postings of a word, with the names of their files."""
    engine = _indexed(spark, d)
    return engine.postings("token").join(engine.files(), "file_id").select("file_id", "name", "tf")


@query("index_batches", DOCS + "SELECT (SELECT count(*) FROM files) AS n_files, (SELECT max(file_id) FROM files) AS last_id, count(*) AS n_postings, sum(tf)::BIGINT AS n_tokens FROM tf")
def index_batches(spark, d):
    return _indexed(spark, d).write_stats().select("n_files", "last_id", "n_postings", "n_tokens")


@query("dictionary_batches", DOCS.rstrip() + f""", left_ AS (SELECT * FROM tf WHERE file_id NOT IN (SELECT file_id FROM files WHERE {GONE})),
words_ AS (SELECT word, sum(tf)::BIGINT AS count, count(*) AS df FROM left_ GROUP BY word)
SELECT word, count, df, least(255, (count * 5120) // (SELECT sum(count) FROM words_))::INT AS freq_bag FROM words_""")
def dictionary_batches(spark, d):
    """The dictionary of six batches with a deletion between them; runs are merged by threes, so by tiers. Only dictionary columns are read."""
    docs = tables.documents(spark, d)
    index = Index(spark, f"{_folder(spark)}/index", fan=3)
    for i in range(6):
        index.add(docs.where(F.pmod("file_id", F.lit(6)) == i))
        if i == 3:
            index.delete(search.find_files(index.files, "doc/1*"))
        index.compact_if_grown()
    index.delete(search.find_files(index.files, "doc/1*"))
    return index.words


@query("word_ids", DOCS + "SELECT word, row_number() OVER (ORDER BY first % 2, word) AS word_id, count, df FROM words JOIN (SELECT word, min(file_id % 2) AS first FROM tf GROUP BY word) USING (word)")
def word_ids(spark, d):
    """Words numbered in the order in which they came, in two batches that are merged then."""
    docs = tables.documents(spark, d)
    index = Index(spark, f"{_folder(spark)}/index")
    for i in range(2):
        index.add(docs.where(F.pmod("file_id", F.lit(2)) == i))
    return index.compact().word_ids()


@query("lookup_find", _found_sql(DOCS.rstrip(), ["*ation", "?e*"]))
def lookup_find(spark, d):
    """Words without a fixed beginning, looked up by their pieces in an index that was merged."""
    return _indexed(spark, d).save().find("*ation", "?e*")


@query("file_terms", DOCS + "SELECT file_id, word, tf FROM tf")
def file_terms(spark, d):
    """What each file gave to the index, from the catalogue: forward, without postings."""
    now = _indexed(spark, d).index_.snapshot()
    return now.terms_of(now.files)


# Files: the tables written out as files of a folder, walked, indexed and searched.


def _written(spark: SparkSession, d: str) -> str:
    """A folder with a file for each page and document; some are empty, binary, hidden or ignored by name."""
    root = f"{_folder(spark)}/tree"
    docs = tables.read(spark, d, "documents").select(F.format_string("docs/%d/_%d.txt", F.col("doc_id") % 7, F.col("doc_id")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.col("doc_id").alias("id"))
    pages = tables.read(spark, d, "pages").select(F.format_string("pages/%d.%s", F.col("page_id"), F.element_at(F.array(F.lit("html"), F.lit("PDF"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"), F.col("page_id").alias("id"))
    some = F.when(F.col("id") % 5 == 0, F.lit(b"")).when(F.col("id") % 5 == 1, F.concat(F.lit(b"\x00"), "content")).otherwise(F.col("content"))
    file_source.write_files(docs.union(pages).select("name", some.alias("content")), root)
    return root


WRITTEN = """WITH every AS (
  SELECT 'docs/' || doc_id % 7 || '/_' || doc_id || '.txt' AS name, coalesce(text, '') AS t, doc_id AS id FROM documents
  UNION ALL SELECT 'pages/' || page_id || '.' || ['html', 'PDF', ''][(page_id % 3 + 1)::INT], coalesce(html, ''), page_id FROM pages
), listed AS (
  SELECT name, CASE WHEN id % 5 = 0 THEN '' ELSE t END AS t, id % 5 = 1 AS odd FROM every WHERE name NOT LIKE '%.PDF'
)
"""


@query("walk_list", WRITTEN + "SELECT name, octet_length(encode(t)) + odd::INT AS length FROM listed")
def walk_list(spark, d):
    """Names and sizes that a walk finds."""
    return file_source.list_files(spark, _written(spark, d)).select("name", "length")


@query(
    "walk_index",
    WRITTEN + "SELECT row_number() OVER (ORDER BY name) AS file_id, name, CASE WHEN odd THEN 'ignore' WHEN t LIKE '<!DOCTYPE%' THEN 'html' ELSE 'text' END AS kind FROM listed",
)
def walk_index(spark, d):
    """The catalogue after two walks, of which the second finds nothing new."""
    engine = Engine(spark, f"{_folder(spark)}/index", _written(spark, d))
    engine.index()
    engine.index()
    return engine.index_.files.select("file_id", "name", "kind")


@query("walk_problems", WRITTEN + "SELECT name, 'maybe binary file' AS message FROM listed WHERE odd")
def walk_problems(spark, d):
    engine = Engine(spark, f"{_folder(spark)}/index", _written(spark, d))
    engine.index()
    return engine.problems()


@query(
    "walk_find",
    WRITTEN.rstrip()
    + f""", texts AS (SELECT name, CASE WHEN t LIKE '<!DOCTYPE%' THEN {_html_sql("t")} ELSE t END AS text FROM listed WHERE NOT odd),
raw AS ({_words_sql("texts", "name", "text")}), terms AS (SELECT file_id AS name, lower(word) AS word FROM raw WHERE lower(word) NOT IN ({STOP_SQL}))
SELECT name, {_lines_sql(['th*', '*ing'], "t")} AS lines FROM listed WHERE name IN (SELECT name FROM terms WHERE word LIKE 'th%' INTERSECT SELECT name FROM terms WHERE word LIKE '%ing')""",
)
def walk_find(spark, d):
    """Files found, with their matching lines, which are read from the files."""
    engine = Engine(spark, f"{_folder(spark)}/index", _written(spark, d))
    engine.index()
    return engine.find_lines("th*", "*ing").select("name", F.array_join("lines", "\n").alias("lines"))


@query("stream_walk", WRITTEN + "SELECT name, CASE WHEN odd THEN 'ignore' WHEN t LIKE '<!DOCTYPE%' THEN 'html' ELSE 'text' END AS kind FROM listed")
def stream_walk(spark, d):
    """The catalogue that a stream makes of the same folder, in micro-batches; a second one finds nothing new."""
    path = _folder(spark)
    engine = Engine(spark, f"{path}/index", _written(spark, d))
    for _ in range(2):
        engine.index_stream(f"{path}/checkpoint", per_batch=max(100, tables.read(spark, d, "documents").count() // 4))
    return engine.index_.files.select("name", "kind")


@query(
    "page_lines",
    WRITTEN.rstrip()
    + f""", numbered AS (SELECT row_number() OVER (ORDER BY name) AS file_id, * FROM listed),
texts AS (SELECT file_id, CASE WHEN t LIKE '<!DOCTYPE%' THEN {_html_sql("t")} ELSE t END AS text FROM numbered WHERE NOT odd),
raw AS ({_words_sql("texts", "file_id", "text")}), terms AS (SELECT file_id, lower(word) AS word FROM raw WHERE lower(word) NOT IN ({STOP_SQL})),
found AS (SELECT file_id FROM terms WHERE word LIKE 'th%' INTERSECT SELECT file_id FROM terms WHERE word LIKE '%re')
SELECT file_id, name, {_lines_sql(['th*', '*re'], "t")} AS lines FROM numbered WHERE file_id IN (SELECT file_id FROM found WHERE file_id > 30 ORDER BY file_id LIMIT 20)""",
)
def page_lines(spark, d):
    """A page of results after a file's id, with lines: twenty files are opened, whatever was found."""
    engine = Engine(spark, f"{_folder(spark)}/index", _written(spark, d))
    engine.index()
    some = search.page_after(engine.find("th*", "*re"), 30)
    return engine.with_lines(some, "th*", "*re").select("file_id", "name", F.array_join("lines", "\n").alias("lines"))


@query("prompt_pages", DOCS.rstrip() + """, found AS (SELECT file_id FROM terms WHERE word LIKE 'th%' INTERSECT SELECT file_id FROM terms WHERE word LIKE '%re'),
pages AS (SELECT row_number() OVER (ORDER BY file_id) - 1 AS i, name FROM files JOIN found USING (file_id))
SELECT shown, i, name FROM pages JOIN (VALUES (0, 0), (1, 20), (2, 0)) v(shown, start) ON i >= start AND i < start + 20""")
def prompt_pages(spark, d):
    """What the prompt shows for find, next and first: pages of twenty files."""
    out, shown = io.StringIO(), []
    prompt = Prompt(_indexed(spark, d), stdout=out)
    docs = tables.documents(spark, d)
    prompt.engine.find_pages = partial(prompt.engine.find_pages, texts=docs.select("file_id", "text"))
    for number, line in enumerate(("find th* *re", "next", "first")):
        out.seek(0), out.truncate()
        prompt.onecmd(line)
        shown += [(number, int(m[1]), m[2]) for m in re.finditer(r"(?m)^  ([0-9]+):(doc/.*)$", out.getvalue())]
    return spark.createDataFrame(shown, "shown int, i long, name string")
