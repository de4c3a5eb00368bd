"""Aggregations: bounds and counts of runs, tiles and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakfield.functions.points import VALUE
from peakfield.functions.sums import exact_sums


def ranges() -> list[Column]:
    names = (("mz", "mz"), ("rt", "rt"), ("intensity", "int"))
    return [f(axis).alias(f"{short}_{end}") for axis, short in names for end, f in (("min", F.min), ("max", F.max))]


def dataset_summary(df: DataFrame) -> DataFrame:
    """Bounds of the three axes and the number of points, a row for each run."""
    return df.groupBy("run_id").agg(*ranges(), F.count("*").alias("point_count"))


def count_points(spectra: DataFrame, least: float = 1.0) -> DataFrame:
    """How many peaks of each run reach ``least``, counted inside the arrays."""
    return spectra.groupBy("run_id").agg(F.coalesce(F.sum(F.size(F.filter("intensity", lambda x: x >= least))), F.lit(0)).alias("n_points"))


def axis_sums(df: DataFrame) -> DataFrame:
    """Sums of the axes in double precision, the same in whatever order rows come."""
    return exact_sums(df, ["run_id"], {"mz_sum": F.col("mz"), "rt_sum": F.col("rt"), "int_sum": F.col("intensity")})


def tile_bounds(df: DataFrame) -> DataFrame:
    """Bounds and number of points of each leaf tile."""
    return df.groupBy("run_id", "leaf_depth", "tile_id").agg(*ranges(), F.count("*").alias("n_points"))


def ancestor(depth: int | str, base: int) -> Column:
    """The tile at ``depth`` that a point's leaf tile lies in: tile ids have one digit, in ``base``, for each level."""
    return F.expr(f"tile_id div cast(power({base}, leaf_depth - ({depth})) as bigint)")


def tile_bounds_rollup(leaves: DataFrame, base: int) -> DataFrame:
    """The tiles table: every tile with the bounds of what lies below it, from leaf bounds alone.

    leaves: from tile_bounds. Each leaf adds itself to its ancestors, height + 1 rows at
    most; bounds of bounds are exact, so the points are not read again.
    """
    up = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("leaf_depth"))))
    up = up.select("run_id", "depth", ancestor("depth", base).alias("tile_id"), "leaf_depth", *(f"{a}_{e}" for a in ("mz", "rt", "int") for e in ("min", "max")), "n_points")
    ends = [(F.min if e == "min" else F.max)(f"{a}_{e}").alias(f"{a}_{e}") for a in ("mz", "rt", "int") for e in ("min", "max")]
    found = up.groupBy("run_id", "depth", "tile_id").agg(F.sum("n_points").alias("n_points"), F.max(F.col("leaf_depth") == F.col("depth")).alias("is_leaf"), *ends)
    return found.withColumn("parent_id", F.when(F.col("depth") > 0, F.expr(f"tile_id div {base}")))


def tile_point_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id", "leaf_depth", "tile_id").agg(F.sort_array(F.collect_list("point_id")).alias("point_ids"))


def tree_shape(tiles: DataFrame) -> DataFrame:
    """For each depth: tiles, leaves, and the most children that a tile there has."""
    children = tiles.where("parent_id IS NOT NULL").groupBy("run_id", (F.col("depth") - 1).alias("depth"), F.col("parent_id").alias("tile_id")).agg(F.count("*").alias("fan_out"))
    joined = tiles.join(children, ["run_id", "depth", "tile_id"], "left")
    return joined.groupBy("run_id", "depth").agg(F.count("*").alias("n_tiles"), F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"), F.coalesce(F.max("fan_out"), F.lit(0)).alias("max_fan_out"))


def distinct_points(df: DataFrame) -> DataFrame:
    """One point for each value, the one with the smallest id."""
    return df.groupBy("run_id", *VALUE).agg(F.min("point_id").alias("point_id"))


def points_per_level(levels: DataFrame) -> DataFrame:
    """How many of the points each depth offers: those with lod at or above it."""
    counts = levels.groupBy("run_id", "lod").agg(F.count("*").alias("n"))
    later = counts.select("run_id", F.col("lod").alias("depth"), "n")
    return counts.select("run_id", F.col("lod").alias("depth")).join(later.withColumnRenamed("depth", "lod"), "run_id").where("lod <= depth").groupBy("run_id", "depth").agg(F.sum("n").alias("n_points"))
