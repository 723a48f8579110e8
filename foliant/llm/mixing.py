r"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule w(t) = w * (1 + ramp * (2t - 1)) over the run, t from 0 to 1; its integral
is the source's weight, which gives its target of words. Within a source the documents follow one another in
the order of md5(doc_id); the words before a document, counted over as many passes as the target needs, are
the demand at which it is due. Inverting the integral of the schedule turns that demand into the training
position t, and sorting all chosen copies by position gives the mix. A copy is taken if its middle lies within
its source's target, so a source misses its target by half a document at most.

Running sums over a source are made in two levels, 4096 hash blocks a source and the rows of a block, so that
a source with a third of all rows is spread over many tasks.

Defined results: a null text has size 0; null sources form one source, the last; rows that share doc_id,
source and size are one unit and are taken alike; a null doc_id comes first in its source; with no words at all
every target is 0; very long texts are one unit as any other; an empty table gives an empty result. Other columns are carried
by mix(), whatever their names, and never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, table, text_of, workspace

SHARE = 1.5  # the mix takes so many times the words there are
MOST = 2.0  # a source gives at most so many times its own words
WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
RAMPS = (-0.5, 0.0, 0.5)  # heavy sources fade, light ones grow


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_key(source: str | Column = "source") -> Column:
    """Sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("1"), (F.col(source) if isinstance(source, str) else source).cast("string")), F.lit("2"))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, ramps: tuple = RAMPS) -> DataFrame:
    """From (src, source_size): src, source_size, target, ramp. Sources above their limit are cut to it and the excess goes to the others by weight."""
    rank = F.row_number().over(Window.orderBy("src")) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("rank") % len(values) + 1).cast("int"))
    w = sizes.withColumn("rank", rank).withColumn("w", pick(weights)).withColumn("ramp", pick(ramps)).withColumn("most", F.col("source_size") * F.lit(most))
    # Those with the least limit for their weight reach it first: find the level at which no other does.
    order = Window.orderBy(F.col("most") / F.col("w"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    at = w.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.col("level") * F.col("w") <= F.col("most")
    at = at.withColumn("first", F.min(F.when(fits, F.col("place"))).over(everything))
    at = at.withColumn("final", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything))
    return at.select("src", "source_size", F.when(F.col("place") < F.col("first"), F.col("most")).otherwise(F.col("final") * F.col("w")).alias("target"), "ramp")


def plan(docs: DataFrame, path: str, **how) -> DataFrame:
    """One row per unit: doc_id, src, size, n (rows), source_size, target, due (words before it), positions (one a copy)."""
    units = staged(
        docs.select(F.col("doc_id"), source_key().alias("src"), n_words().alias("size")).groupBy("doc_id", "src", "size").agg(F.count(F.lit(1)).alias("n")),
        f"{path}/units",
    )
    units = units.withColumn("at", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))).withColumn("block", F.substring("at", 1, 3)).withColumn("words", F.col("size") * F.col("n"))
    blocks = units.groupBy("src", "block").agg(F.sum("words").alias("block_words"))
    sources = blocks.groupBy("src").agg(F.sum("block_words").alias("source_size"))
    ahead = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a source
    blocks = blocks.withColumn("block_start", F.coalesce(F.sum("block_words").over(ahead), F.lit(0))).drop("block_words")
    blocks = blocks.join(targets(sources, **how), "src")
    within = Window.partitionBy("src", "block").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = units.join(blocks, ["src", "block"]).withColumn("due", F.col("block_start") + F.coalesce(F.sum("words").over(within), F.lit(0)))
    passes = math.ceil(how.get("most", MOST))  # no target is larger
    middle = lambda k: F.col("due") + k * F.col("source_size") + F.col("words") / 2.0
    copies = F.array_compact(F.array(*[F.when((middle(k) <= F.col("target")) & (F.col("words") > 0), position(middle(k))) for k in range(passes)]))
    return staged(rows.withColumn("positions", copies).select("doc_id", "src", "size", "n", "source_size", "target", "due", "positions"), f"{path}/plan")


def position(demand: Column) -> Column:
    """The t at which the integral of the schedule, t + ramp * (t*t - t), reaches this part of the target."""
    part, b = demand / F.col("target"), F.lit(1.0) - F.col("ramp")
    return F.lit(2.0) * part / (b + F.sqrt(b * b + F.lit(4.0) * F.col("ramp") * part))


def mix(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, sorted by training position. Columns may have any name."""
    made = plan(docs, path or workspace(docs.sparkSession, "mix"), **how).where(F.size("positions") > 0)
    made = made.select(F.col("doc_id").alias("doc"), F.col("src").alias("of"), F.col("size").alias("has"), "positions")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), source_key(F.col("row.source")).alias("src"), n_words(F.col("row.text")).alias("size"))
    match = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("src") == F.col("of")) & (F.col("size") == F.col("has"))
    return rows.join(made, match).select("row", "doc", F.explode("positions").alias("position")).sort("position", "doc").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(table(spark, sf_dir, "documents"), workspace(spark, "mix"))
    first = F.round(F.element_at(F.concat("positions", F.array(F.lit(None).cast("double"))), 1), 9)
    return (
        rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), first.alias("position"), F.explode(F.expr("sequence(1, n)")).alias("_"))
        .drop("_")
        .sort("position", "doc_id")  # documents that aren't taken have no position, and their ids deal them out
    )


ORACLE = r"""
WITH units AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS src, size, count(*) AS n, size * count(*) AS words,
         coalesce(md5(doc_id::VARCHAR), '') AS spot
  FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents)
  GROUP BY doc_id, source, size
), sources AS (
  SELECT src, sum(words)::BIGINT AS source_size, row_number() OVER (ORDER BY src) - 1 AS rank FROM units GROUP BY src
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank % 3 + 1)::INT] AS w, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][(rank % 3 + 1)::INT] AS ramp,
         source_size * 2.0::DOUBLE AS most FROM sources
), levels AS (
  SELECT *, row_number() OVER o AS place,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY most / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY most / w, src)
), chosen AS (
  SELECT min(place) AS first, arg_min(level, place) AS final FROM levels WHERE level * w <= most
), targets AS (
  SELECT src, source_size, ramp, CASE WHEN place < first THEN most ELSE final * w END AS target FROM levels, chosen
), placed AS (
  SELECT u.*, t.source_size, t.target, t.ramp,
         coalesce(sum(words) OVER (PARTITION BY u.src ORDER BY spot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS due
  FROM units u JOIN targets t USING (src)
), taken AS (
  SELECT *, (words > 0 AND due + words / 2.0::DOUBLE <= target)::INT + (words > 0 AND due + source_size + words / 2.0::DOUBLE <= target)::INT AS copies,
         (due + words / 2.0::DOUBLE) / target AS part FROM placed
)
SELECT doc_id, size, source_size, target, size * copies AS taken,
       CASE WHEN copies > 0 THEN round(2.0::DOUBLE * part / ((1.0::DOUBLE - ramp) + sqrt((1.0::DOUBLE - ramp) * (1.0::DOUBLE - ramp) + 4.0::DOUBLE * ramp * part)), 9) END AS position
FROM (SELECT *, unnest(range(n)) AS i FROM taken)
"""
