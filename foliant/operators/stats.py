"""Dictionary and statistics, all derived from postings (word, file_id, tf)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAGS = 256
SHARE = 20  # bags divide frequencies from 0 to 1/SHARE evenly


def word_stats(postings: DataFrame) -> DataFrame:
    """word, count (occurrences), df (files)."""
    return postings.groupBy("word").agg(F.sum("tf").alias("count"), F.count(F.lit(1)).alias("df"))


def total_words(postings: DataFrame) -> DataFrame:
    return postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))


def frequency_bags(words: DataFrame) -> DataFrame:
    """word, count, df and freq_bag: the class of a word's share of all occurrences; 0 if there are none. The total is one row."""
    total = words.agg(F.sum("count").alias("_total"), F.sum("df").alias("_postings"))  # of both columns, so that both sides read one shuffle
    bag = F.when((F.col("_total") == 0) | (F.col("_postings") == 0), 0).otherwise(F.least(F.lit(BAGS - 1), F.expr(f"count * {BAGS * SHARE} div _total")))
    return words.crossJoin(F.broadcast(total)).select("word", "count", "df", bag.cast("int").alias("freq_bag"))


def bag_histogram(bags: DataFrame) -> DataFrame:
    return bags.groupBy("freq_bag").agg(F.count(F.lit(1)).alias("n_words"))


def inverted_frequencies(frequencies: DataFrame) -> DataFrame:
    """From (file_id, word, tf): file_id, tf and the words that occur so often in the file, sorted."""
    return frequencies.groupBy("file_id", "tf").agg(F.sort_array(F.collect_list("word")).alias("words"))


def df_histogram(words: DataFrame) -> DataFrame:
    """df, n_words, and the percentage of words in so many files or fewer. The window sees one row a df."""
    counts = words.groupBy("df").agg(F.count(F.lit(1)).alias("n_words"))
    upto = Window.orderBy("df").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    return counts.select("df", "n_words", (F.sum("n_words").over(upto) * F.lit(100.0) / F.sum("n_words").over(every)).alias("cum_percent"))


def rare_words(words: DataFrame, n_files: DataFrame, share: float = 0.1) -> DataFrame:
    """word, df of words in at most this share of the files. n_files: one row with the column n."""
    return words.crossJoin(F.broadcast(n_files)).where(F.col("df") <= F.floor(F.col("n") * F.lit(share))).select("word", "df")


def index_stats(files: DataFrame, words: DataFrame) -> DataFrame:
    """One row: n_files, n_words, n_tokens, n_postings."""
    of_words = words.agg(F.count(F.lit(1)).alias("n_words"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"))
    return files.agg(F.count(F.lit(1)).alias("n_files")).crossJoin(F.broadcast(of_words))


def posting_stats(postings: DataFrame, word: str) -> DataFrame:
    """Of one word: files, occurrences, first and last file."""
    return postings.where(F.col("word") == word).agg(
        F.count(F.lit(1)).alias("df"), F.coalesce(F.sum("tf"), F.lit(0)).alias("count"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file")
    )
