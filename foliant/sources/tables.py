"""Tables whose rows act as files: file_id, name, kind, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.html import html_to_text
from foliant.operators.tokens import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.format_string("doc/%d.txt", F.col("doc_id")).alias("name"), F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


def pages(spark: SparkSession, sf_dir: str, modern: bool = True) -> DataFrame:
    p = spread(read(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")  # before markup is read, not after
    return p.select(F.col("page_id").alias("file_id"), F.col("url").alias("name"), F.lit("html").alias("kind"), html_to_text(F.coalesce("html", F.lit("")), modern).alias("text"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("file_id"), F.format_string("benchmark/%d.txt", F.col("item_id")).alias("name"), F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a turn; its id puts the conversation in the high and the turn in the low 20 bits."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * F.lit(1 << 20) + F.col("turn")).alias("file_id"),
        F.format_string("conversation/%d/%d.txt", F.col("conv_id"), F.col("turn")).alias("name"),
        F.lit("text").alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
