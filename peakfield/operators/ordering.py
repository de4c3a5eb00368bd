"""Order: dense ids, ranks, chunks and limits without a window over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfield.functions.scratch import written

def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in the given order, with _part, a task's number, and _row, the place in it.

    A range sort deals the rows over tasks. Places are written along with the rows before anything is
    counted, so no later run can see another partitioning.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    return placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")


def _bases(cells: DataFrame) -> DataFrame:
    """cells: (_part, _n) -> (_part, _base), the rows in the tasks before; a row for each task."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return cells.groupBy("_part").agg(F.sum("_n").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))


def global_index(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... in the given order, which has to be total: each row's place in its task plus the rows of the tasks before."""
    placed = _placed(df, order)
    bases = _bases(placed.groupBy("_part").agg(F.count("*").alias("_n")))
    return placed.join(F.broadcast(bases), "_part").withColumn(out, F.col("_base") + F.col("_row")).drop("_part", "_base", "_row")


def assign_point_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds point_id, dense from 0 in the given order."""
    return global_index(df, order, "point_id")


def index_within(df: DataFrame, group: list[str], order: list[str], out: str = "idx", large: bool = True) -> DataFrame:
    """Adds ``out``, counted from 0 within each group, and ``n``, the group's size.

    ``large``: groups may be of any size, and one range sort serves them all. Otherwise each
    group is a window's partition, which suits groups with a known bound, such as tiles.
    """
    if not large:
        whole = Window.partitionBy(*group)
        return df.withColumn(out, (F.row_number().over(whole.orderBy(*order)) - 1).cast("long")).withColumn("n", F.count("*").over(whole))
    placed = _placed(df, [*group, *order])
    of_group = Window.partitionBy(*group)
    # a row for each group and task that has rows of it, counted once for all that later reads the result
    cells = written(placed.groupBy(*group, "_part").agg(F.min("_row").alias("_start"), F.count("*").alias("_n")), "cells")
    cells = cells.join(F.broadcast(_bases(cells)), "_part").withColumn("_first", F.min(F.col("_base") + F.col("_start")).over(of_group))
    cells = cells.select(*group, "_part", (F.col("_base") - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias("n"))
    return placed.join(cells, [*group, "_part"]).withColumn(out, F.col("_row") + F.col("_shift")).select(*df.columns, out, "n")


def chunk_split(df: DataFrame, group: list[str], order: list[str], k: int, large: bool = True) -> DataFrame:
    """Adds chunk: consecutive chunks of ceil(n / k) rows within each group; the last may be short."""
    rows = index_within(df, group, order, "_idx", large)
    return rows.withColumn("chunk", F.expr(f"_idx div cast(ceil(n / {k}) as bigint)")).drop("_idx", "n")


def fixed_chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds chunk: consecutive chunks of ``size`` rows of the whole table."""
    return global_index(df, order, "_idx").withColumn("chunk", F.expr(f"_idx div {size}")).drop("_idx")


def sort_points(df: DataFrame, axis: str) -> DataFrame:
    """Sorted by an axis; the id makes ties the same in every run."""
    return df.orderBy(axis, "point_id")


def limit_points(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n in the given order; 0 is no limit."""
    return df.orderBy(*order).limit(n) if n else df
