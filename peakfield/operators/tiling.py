"""Equal-count tiles: runs are split by rt, then mz, then rt, ... until a tile holds no more than its capacity."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfield.functions.scratch import written
from peakfield.operators.ordering import index_within

CAPACITY, HEIGHT = 8192, 4
#: What names a leaf tile: its id alone would not, as each level numbers its tiles from 0.
TILE = ["run_id", "leaf_depth", "tile_id"]


def tree_config(n: int, capacity: int = CAPACITY, height: int = HEIGHT) -> tuple[int, int]:
    """(leaves, fan-out): the least fan-out b with b ** height >= leaves."""
    leaves = max(1, ceil(n / capacity))
    fan_out = 1
    while fan_out**height < leaves:
        fan_out += 1
    return leaves, fan_out


def height_for(n: int, capacity: int, fan_out: int, most: int | None = None) -> tuple[int, int]:
    """(height, points that a leaf has at most): the least height at which n points lie in leaves of ``capacity``, or ``most``, where leaves may hold more."""
    height, leaf = 0, n
    while fan_out**height * capacity < n and (most is None or height < most):
        height, leaf = height + 1, ceil(leaf / fan_out)
    return height, leaf


def largest_run(df: DataFrame) -> int:
    return df.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0


def tile(df: DataFrame, fan_out: int, capacity: int = CAPACITY, height: int = HEIGHT) -> DataFrame:
    """Adds tile_id and leaf_depth. A tile's id has one digit in base ``fan_out`` for each level above it.

    Each level is one range sort, written once, of the points that lie in tiles over capacity; equal counts make
    the tiles themselves even, however the points are spread. The sizes of a tile's children follow
    from its own, so nothing is counted again. At most ``height`` rounds.
    """
    columns = [*df.columns, "tile_id", "leaf_depth"]
    runs = written(df.groupBy("run_id").agg(F.count("*").alias("_size")), "runs")  # a row for each run, counted once
    largest = runs.agg(F.max("_size")).first()[0] or 0
    left = df.join(runs, "run_id").withColumn("tile_id", F.lit(0).cast("long")).withColumn("leaf_depth", F.lit(0)).select(*columns, "_size")
    done = []
    for depth in range(height):
        if fan_out < 2 or largest <= capacity:
            break
        done.append(left.where(F.col("_size") <= capacity))
        split = index_within(left.where(F.col("_size") > capacity), TILE, ["rt" if depth % 2 == 0 else "mz", "point_id"], "_idx")
        share = F.expr(f"cast(ceil(n / {fan_out}) as bigint)")
        largest = ceil(largest / fan_out)  # no child is larger than the largest tile's
        split = split.withColumn("_share", share).withColumn("_child", F.expr("_idx div _share")).withColumn("tile_id", F.expr(f"tile_id * {fan_out} + _child"))
        left = split.withColumn("_size", F.expr("least(_share, n - _child * _share)")).withColumn("leaf_depth", F.lit(depth + 1)).select(*columns, "_size")
    return written(reduce(DataFrame.union, [*done, left]).select(*columns), "tiled")
