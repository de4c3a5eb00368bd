"""Compaction: batch trees whose retention times overlap become one tree, without building anew what does not overlap.

The children of a batch's root are slices of rt. Slices of different batches that overlap, by more than a shared edge, are chained into
parts; the points of a part of several slices are tiled and summarized again, a slice by itself stays as it is, as a part of its own. Parts
are numbered by rt, and as in ``joined_tree`` their numbers lead the tile ids below a common root, so only the levels above the parts are
summarized again for what stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfield.functions.points import POINT
from peakfield.functions.scratch import written
from peakfield.operators.pyramid import levels, risen
from peakfield.operators.tiling import height_for, tile
from peakfield.streaming.ingest import FAN_OUT

TREE = ["tile_id", "leaf_depth", "lod"]


def _power(base: int, exponent: str) -> Column:
    return F.expr(f"cast(power({base}, {exponent}) as bigint)")


def slices_of(points: DataFrame, fan_out: int) -> DataFrame:
    """points with a batch -> with ``slice``: the child of its batch's root that a point lies below, -1 where the root is a leaf."""
    return points.withColumn("slice", F.when(F.col("leaf_depth") == 0, F.lit(-1).cast("long")).otherwise(F.expr(f"tile_id div cast(power({fan_out}, leaf_depth - 1) as bigint)")))


def parts_of(sliced: DataFrame) -> DataFrame:
    """(run_id, batch, slice, part, n_slices, n_points): chains of slices that overlap in rt, numbered by rt within each run; a row for each slice."""
    bounds = written(sliced.groupBy("run_id", "batch", "slice").agg(F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"), F.count("*").alias("n")), "slices")
    order = Window.partitionBy("run_id").orderBy("rt_min", "rt_max", "batch", "slice")
    reached = F.max("rt_max").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached.isNull() | (F.col("rt_min") >= reached), 1).otherwise(0)
    numbered = bounds.withColumn("_begins", begins).withColumn("part", (F.sum("_begins").over(order) - 1).cast("long"))
    whole = Window.partitionBy("run_id", "part")
    return written(numbered.select("run_id", "batch", "slice", "part", F.count("*").over(whole).alias("n_slices"), F.sum("n").over(whole).alias("n_points")), "parts")


def compacted(spark: SparkSession, out: str, capacity: int, fan_out: int = FAN_OUT, strategy: str = "WeightedStriding", height: int | None = None) -> DataFrame:
    """One pyramid over all batches below ``out``, in which no two parts of a run overlap in rt by more than an edge; nothing below ``out`` is changed.

    ``height``: levels below the root of a part that is built anew at most, as ``ingest_stream`` has it for batches.
    """
    sliced = slices_of(spark.read.parquet(f"{out}/points"), fan_out)
    parts = parts_of(sliced)
    n_parts, largest = parts.agg(F.max("part"), F.max(F.when(F.col("n_slices") > 1, F.col("n_points")))).first()
    placed = sliced.join(parts, ["run_id", "batch", "slice"])
    # a slice's tree is its batch's without the root
    below = F.when(F.col("slice") < 0, F.col("tile_id")).otherwise(F.col("tile_id") - F.col("slice") * _power(fan_out, "leaf_depth - 1"))
    kept = placed.where("n_slices = 1").withColumn("tile_id", below)
    kept = kept.withColumn("leaf_depth", F.greatest(F.lit(0), F.col("leaf_depth") - 1)).withColumn("lod", F.greatest(F.lit(0), F.col("lod") - 1)).select(*POINT.names, *TREE, "part")
    both = kept
    if largest:
        tall, leaf = height_for(largest, capacity, fan_out, height)
        # a part is a run of its own while it is tiled
        loose = placed.where("n_slices > 1").select(F.concat("part", F.lit(":"), "run_id").alias("run_id"), *POINT.names[1:], "part", F.col("run_id").alias("_run"))
        again = levels(tile(loose, fan_out, capacity, tall), fan_out, capacity, tall, strategy, leaf)
        both = kept.unionByName(again.withColumn("run_id", F.col("_run")).select(*POINT.names, *TREE, "part"))
    top = 0
    while fan_out**top < (n_parts or 0) + 1:
        top += 1
    rows = both.withColumn("tile_id", F.col("part") * _power(fan_out, "leaf_depth") + F.col("tile_id")).drop("part")
    return risen(rows.withColumn("leaf_depth", F.col("leaf_depth") + top).withColumn("lod", F.col("lod") + top), fan_out, capacity, top, strategy)
