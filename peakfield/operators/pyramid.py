"""The multi-resolution pyramid as one column, and queries on it.

``lod`` is the shallowest depth at which a point is shown: a depth d shows the points with lod <= d.
Each inner tile shows ``capacity`` of what its children show, so a point's depths are an interval
and no row is stored twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfield.functions.scratch import written
from peakfield.operators.boxes import Box, in_box
from peakfield.operators.bounds import ancestor
from peakfield.operators.sampling import REPEATING, WINDOW_ROWS, summarize
from peakfield.operators.sketched import tile_sketched
from peakfield.operators.tiling import CAPACITY, HEIGHT, largest_run, tile, tree_config


def build_pyramid(df: DataFrame, capacity: int = CAPACITY, height: int = HEIGHT, strategy: str = "WeightedStriding", sketched: bool = False) -> DataFrame:
    """df: points with ids -> the points with tile_id, leaf_depth and lod. Tiles are digits in base ``fan_out`` (tree_config of the largest run).

    ``sketched``: the same tiles by ``tile_sketched``, for a stored table of which reading costs less than sorting.
    """
    _, fan_out = tree_config(largest_run(df), capacity, height)
    tiled = (tile_sketched if sketched else tile)(df, fan_out, capacity, height)
    return levels(tiled, fan_out, capacity, height, strategy)


def levels(tiled: DataFrame, fan_out: int, capacity: int, height: int, strategy: str, leaf: int = 0) -> DataFrame:
    """Adds lod, from the leaves up: of the points that an inner tile's children show, its summary rises a level."""
    return risen(tiled.withColumn("lod", F.col("leaf_depth")), fan_out, capacity, height, strategy, leaf)


def risen(rows: DataFrame, fan_out: int, capacity: int, top: int, strategy: str, leaf: int = 0) -> DataFrame:
    """rows: points with a lod, which summaries of the depths above ``top`` lessen.

    Only what rose to a depth is carried on and written, a part of what rose to the one below; the points
    themselves are joined with their lod and written once, at the end. A summary looks at fan_out * capacity
    points at most, so each is one window's partition; where a height was given that leaves ``leaf`` points, more than
    the capacity, in the tiles at ``top``, the summaries above these look at fan_out * leaf.
    """
    if strategy in REPEATING:
        raise ValueError(f"{strategy} may repeat points, so it summarizes no tiles")
    rose = []
    for depth in reversed(range(top)):
        shown = rows.where(F.col("lod") == depth + 1)
        most = fan_out * max(capacity, leaf if depth == top - 1 else 0)
        settings = {"large": most > max(WINDOW_ROWS, fan_out * capacity)} if "Striding" in strategy else {}
        shown = shown.unionByName(rose[-1]) if rose else shown
        best = summarize(shown.withColumn("_up", ancestor(depth, fan_out)), capacity, strategy, ["run_id", "_up"], **settings)
        rose.append(written(best.drop("_up").withColumn("lod", F.lit(depth)), "risen"))
    if not rose:
        return rows
    least = reduce(DataFrame.union, [r.select("run_id", "point_id", "lod") for r in rose]).groupBy("run_id", "point_id").agg(F.min("lod").alias("_lod"))
    return written(rows.join(least, ["run_id", "point_id"], "left").withColumn("lod", F.coalesce("_lod", "lod")).select(*rows.columns), "levels")


def query_viewport(pyramid: DataFrame, box: Box, n: int, strategy: str = "WeightedStriding") -> DataFrame:
    """About n representative points inside ``box``: the shallowest depth with n of them, summarized to n.

    If no depth has n, all points inside; n = 0: all points inside. Only the counts by depth (a row
    for each depth) are looked at before the rows of the chosen depth are read.
    """
    inside = in_box(pyramid, box)
    if not n:
        return inside
    total = 0
    for row in inside.groupBy("lod").count().orderBy("lod").collect():  # a row for each depth
        total += row["count"]
        if total >= n:
            shown = inside.where(F.col("lod") <= row["lod"])
            return shown if total == n else summarize(shown.withColumn("_one", F.lit(0)), n, strategy, ["_one"]).drop("_one")
    return inside
