"""From texts to terms: DataFrames of (file_id, term)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.stopwords import default_list, stop_words_sql, usable
from foliant.functions.text import matched, term, words

BYTES_A_TASK = 4 << 20  # of a table whose words a task counts
UNKNOWN = 1 << 60  # bytes of what Spark can't estimate


def spread(df: DataFrame, by: str | None = None) -> DataFrame:
    """Tokenizing is costly and a small file is one split: deal the rows of such a scan over all cores. Larger scans and tables that
    are shuffled anyway stay as they are. Dealt by a hash of `by`, rows need no further shuffle to be grouped or joined by it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "AdaptiveSparkPlan" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *([by] if by else [])) if df._jdf.rdd().getNumPartitions() < cores else df


def _texts(texts: DataFrame) -> DataFrame:
    return spread(texts.select("file_id", "text"), "file_id")


def _dealt(texts: DataFrame) -> DataFrame:
    """Rows of a scan that spread() would leave alone, dealt by file_id to as many tasks as its bytes need. Other plans stay as they are."""
    dealt = spread(texts, "file_id")
    leaves = texts._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if dealt is not texts or size >= UNKNOWN or "Exchange" in (plan := texts._jdf.queryExecution().executedPlan().toString()) or "AdaptiveSparkPlan" in plan:
        return dealt
    return texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // BYTES_A_TASK)), "file_id")


def raw_words(texts: DataFrame) -> DataFrame:
    """From (file_id, text): file_id, word; every word as it is written."""
    return _texts(texts).select("file_id", F.explode(words(F.col("text"))).alias("word"))


def all_terms(texts: DataFrame) -> DataFrame:
    """file_id, word; every word in lower case, stop words included."""
    return _texts(texts).select("file_id", F.explode(F.transform(words(F.col("text")), term)).alias("word"))


def _kept(stop_words: Iterable[str] | None) -> Column:
    """Of the array column lowered, what isn't a stop word."""
    return F.expr(f"filter(lowered, w -> w NOT IN ({stop_words_sql(stop_words)}))")


def term_array(text: Column, stop_words: Iterable[str] | None = None) -> Column:
    """What is indexed of a text, in order; null of a null. What isn't a word is left out together with stop words, in one pass."""
    listed = default_list() if stop_words is None else usable(stop_words)
    return F.filter(F.transform(matched(text), term), lambda w: ~w.isin("", *listed))


def counted(words: Column) -> Column:
    """word, tf of each word of an array, as an array of structs; null of a null. Equal words stand side by side when they are sorted, so
    they are counted within their row: nothing is shuffled or held in a table."""

    def runs(held: Column, starts: Column) -> Column:
        until = lambda k: F.coalesce(F.get(starts, k + 1), F.size(held))
        return F.transform(starts, lambda at, k: F.struct(F.get(held, at).alias("word"), (until(k) - at).cast("long").alias("tf")))

    return F.when(words.isNotNull(), once(F.sort_array(words), lambda held: once(_starts(held), lambda s: runs(held, s))))


def _starts(held: Column) -> Column:
    """Of a sorted array, the places at which its values begin."""
    places = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.size(held) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda at: (at == 0) | (F.get(held, at) != F.get(held, at - 1)))


def counted_apart(rows: DataFrame, words: str) -> DataFrame:
    """rows with terms and tfs in place of the array column words: what counted() gives, as two arrays and without a struct for each word."""
    others, held = [c for c in rows.columns if c != words], F.col("_held")
    starts = rows.select(*others, F.sort_array(words).alias("_held")).select(*others, "_held", F.when(F.col("_held").isNotNull(), _starts(F.col("_held"))).alias("_starts"))
    tfs = F.transform("_starts", lambda at, k: (F.coalesce(F.get("_starts", k + 1), F.size("_held")) - at).cast("long"))
    return starts.select(*others, F.transform("_starts", lambda at: F.get(held, at)).alias("terms"), tfs.alias("tfs"))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def terms(texts: DataFrame, stop_words: Iterable[str] | None = None) -> DataFrame:
    """file_id, word; what is indexed. Stop words, a third of all words, leave the array before a row is made of each word."""
    lowered = F.transform(words(F.col("text")), term)
    return _texts(texts).select("file_id", lowered.alias("lowered")).select("file_id", F.explode(_kept(stop_words)).alias("word"))


def term_frequencies(texts: DataFrame, stop_words: Iterable[str] | None = None) -> DataFrame:
    """file_id, word, tf. A text is dealt by its file_id, so that its words, which take more room, aren't shuffled: neither to count them nor
    to group them by file_id again."""
    return terms(_dealt(texts.select("file_id", "text")), stop_words).groupBy("file_id", "word").agg(F.count(F.lit(1)).alias("tf"))


def token_counts(texts: DataFrame, stop_words: Iterable[str] | None = None) -> DataFrame:
    """file_id, token_count (stop words left out), n_words (all of them); every text has a row. No shuffle: one row makes one."""
    lowered = F.transform(words(F.col("text")), term)
    rows = _texts(texts).select("file_id", lowered.alias("lowered"))
    return rows.select("file_id", F.coalesce(F.size(_kept(stop_words)), F.lit(0)).cast("long").alias("token_count"), F.coalesce(F.size("lowered"), F.lit(0)).cast("long").alias("n_words"))
