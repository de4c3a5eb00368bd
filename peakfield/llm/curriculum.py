"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of all words as its target and a weight schedule over training time, which
runs from 0 to 1: its weight at time u is target * (1 + slope * (2u - 1)), so the words that it has
to deliver by time u are the integral, target * (u + slope * (u^2 - u)). Documents of a source stand
in a fixed pseudo-random order, repeated as often as its target needs. The words that stand before
the middle of a document are inverted through the integral, which gives the document's training
position, and documents are range-sorted by position.

Nulls: a null source is a source of its own, the last in order; a null text has size 0. Documents of
size 0 are never taken. Ties in the order are broken by doc_id, then size; repeated rows count each.
An empty table gives an empty mix. Rows without a doc_id are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfield.llm.common import WORD, apart, documents, named, one_row_per_id, running, written

#: Fixed by the contract: weights that sources take in turn, and how often a document may be used.
WEIGHTS, MOST = (1, 2, 3), 3
#: Slopes of the weight schedules that sources take in turn: rising, level, falling.
SLOPES = (0.5, 0.0, -0.5)
#: Buckets of the pseudo-random order: the first hex digits of an MD5.
DIGITS = 3


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): size in words, key the place in the pseudo-random order."""
    size = F.regexp_count("text", F.lit(WORD)).cast("long")
    return named(docs, "source").select("doc_id", "source", size.alias("size"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("key"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, slope), a row for each source.

    Shares by weight stop at MOST times a source's size. What they leave is shared again by weight,
    and so on; sources that stop are those with the least room per weight, so in that order one pass
    finds the level at which the rest share. Only this table of sources is ordered as a whole.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (turn + 1).cast("int"))
    sources = sources.select("source", "source_size", pick(WEIGHTS).cast("long").alias("weight"), pick(SLOPES).alias("slope"), (F.col("source_size") * MOST).alias("room"))
    by_room = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sources = sources.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("room").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"),
    )
    # a source stops if its room is below its part of what is left; beyond the first that does not, none does
    sources = sources.withColumn("stops", F.col("room") * F.col("weights") < F.col("left") * F.col("weight"))
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("room") / F.col("weight"), "left", "weights"))).over(every)
    target = F.when(F.col("stops"), F.col("room").cast("double")).otherwise(F.col("weight") * level["left"] / level["weights"])
    return sources.select("source", "source_size", target.alias("target"), "slope")


def position(demand, slope):
    """The time u in [0, 1] at which u + slope * (u^2 - u) reaches ``demand``."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * demand)
    return F.when(slope == 0, demand).otherwise((root - (1 - slope)) / (2 * slope))


def mixed(sizes: DataFrame) -> DataFrame:
    """sizes: a written table of ``measured`` -> its rows with source_size, target, slope, before and copies.

    A pass over a source's order delivers source_size words; a document is used in pass k if its
    words there end by the target. The one document whose size comes closest to what is then
    missing is used once more, if that brings the source nearer to its target. No document is used
    more than MOST times.
    """
    at = running(sizes.withColumn("bucket", F.substring("key", 1, DIGITS)), ["source"], "bucket", ["key", "doc_id", "size"], F.col("size"), "before").drop("bucket")
    per_source = targets(sizes).withColumnRenamed("source", "_source")
    rows = at.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    passes = F.floor((F.col("target") - (F.col("before") + F.col("size"))) / F.col("source_size")) + 1
    copies = F.when((F.col("size") == 0) | (F.col("source_size") == 0), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(MOST), passes)))
    rows = written(rows.withColumn("copies", copies.cast("int")), "mix")
    gaps = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    gaps = gaps.withColumnRenamed("source", "_source")
    free = rows.where((F.col("size") > 0) & (F.col("copies") < MOST)).join(gaps, F.col("source").eqNullSafe(F.col("_source")))
    miss = F.abs(F.col("gap") - F.col("size"))
    extra = free.where(miss < F.col("gap")).groupBy("source").agg(F.min(F.struct(miss, "key", "doc_id", "size", "before")).alias("x")).select("x.doc_id", "x.size", "x.before").distinct()
    extra = extra.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("before").alias("_before"))
    rows = rows.join(extra, (F.col("doc_id") == F.col("_id")) & (F.col("size") == F.col("_size")) & (F.col("before") == F.col("_before")), "left")
    return rows.withColumn("copies", F.col("copies") + F.when(F.col("_id").isNull(), 0).otherwise(1)).drop("_id", "_size", "_before")


def curriculum(rows: DataFrame) -> DataFrame:
    """The training sequence: ``rows`` of ``mixed``, once for each copy, with ``copy`` and ``position``, range-sorted by position."""
    uses = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    demand = F.least(F.lit(1.0), (F.col("copy") * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target"))
    uses = uses.withColumn("position", position(demand, F.col("slope")))
    return uses.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def mixture(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each document's row as often as it is used, none if never, in training order.

    Of rows that share a doc_id the one with the greatest text stands for the document.
    """
    docs = one_row_per_id(docs)
    rows = mixed(written(measured(docs), "sizes"))
    uses = curriculum(rows).select(F.col("doc_id").alias("_id"), "position", "copy")
    joined = apart(docs).join(uses, F.col("_row.doc_id").cast("long") == F.col("_id"))
    return joined.repartitionByRange("position", "_id", "copy").sortWithinPartitions("position", "_id", "copy").select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op5_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken is summed from the curriculum itself; documents that it does not use have 0."""
    rows = mixed(written(measured(documents(spark, sf_dir)), "sizes"))
    place = {"doc_id": "_id", "size": "_size", "before": "_before"}  # rows that repeat doc_id and size still stand at places of their own
    uses = curriculum(rows).groupBy(*(F.col(c).alias(k) for c, k in place.items())).agg(F.sum("size").alias("taken"), F.min("position").alias("first_position"))
    joined = rows.join(uses, [F.col(c) == F.col(k) for c, k in place.items()], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_position")


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS key
  FROM documents WHERE doc_id IS NOT NULL
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), turns AS (
  SELECT source, source_size, 3 * source_size AS room, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sources
), weighed AS (
  SELECT *, turn + 1 AS weight, CASE turn WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(-0.5 AS DOUBLE) END AS slope FROM turns
), shared AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(room) OVER w, 0) AS BIGINT) AS rest,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weights
  FROM weighed WINDOW w AS (ORDER BY CAST(room AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, room * weights < rest * weight AS stops FROM shared
), level AS (
  SELECT rest, weights FROM leveled WHERE NOT stops ORDER BY CAST(room AS DOUBLE) / weight, rest, weights LIMIT 1
), targets AS (
  SELECT l.source, source_size, slope, CASE WHEN stops THEN CAST(room AS DOUBLE) ELSE CAST(weight * level.rest AS DOUBLE) / level.weights END AS target
  FROM leveled l, level
), placed AS (
  SELECT s.doc_id, s.source, s.size, s.key, source_size, target, slope,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), based AS (
  SELECT *, CASE WHEN size = 0 OR source_size = 0 THEN 0 ELSE CAST(greatest(0, least(3, floor((target - (before + size)) / source_size) + 1)) AS BIGINT) END AS base,
    least(1.0, (before + CAST(size AS DOUBLE) / 2) / target) AS demand
  FROM placed
), gaps AS (
  SELECT *, target - CAST(sum(size * base) OVER (PARTITION BY source) AS DOUBLE) AS gap FROM based
), nearest AS (
  SELECT source, doc_id, size, before FROM gaps WHERE size > 0 AND base < 3 AND abs(gap - size) < gap
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(gap - size), key, doc_id, size) = 1
), mixed AS (
  SELECT g.*, base + CASE WHEN n.doc_id IS NULL THEN 0 ELSE 1 END AS copies
  FROM gaps g LEFT JOIN nearest n ON g.doc_id = n.doc_id AND g.size = n.size AND g.before = n.before
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN CASE WHEN slope = 0 THEN demand ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * demand) - (1 - slope)) / (2 * slope) END END AS first_position
FROM mixed
"""
