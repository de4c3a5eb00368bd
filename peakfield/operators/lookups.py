"""Joins: points by id, tiles and their points, tiles and their children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The points of a list of ids; an id that is listed twice gives its point twice."""
    return df.join(ids.select("point_id"), "point_id")


def unknown_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("point_id").distinct().join(df, "point_id", "left_anti")


def tile_members(tiles: DataFrame, df: DataFrame) -> DataFrame:
    """The points of the given leaf tiles."""
    return df.join(tiles.select("run_id", F.col("depth").alias("leaf_depth"), "tile_id"), ["run_id", "leaf_depth", "tile_id"])


def tile_children(tiles: DataFrame, parents: DataFrame) -> DataFrame:
    """The children of the given tiles. parents: (run_id, depth, tile_id)."""
    wanted = parents.select("run_id", (F.col("depth") + 1).alias("depth"), F.col("tile_id").alias("parent_id"))
    return tiles.join(wanted, ["run_id", "depth", "parent_id"])


def subtree(tiles: DataFrame, base: int, depth: int, tile_id: int) -> DataFrame:
    """A tile and all below it: ids have one digit for each level, so no recursion is needed."""
    below = F.expr(f"tile_id div cast(power({base}, depth - {depth}) as bigint)") == tile_id
    return tiles.where(F.col("depth") >= depth).where(below)
