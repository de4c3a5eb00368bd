"""Windows answered from the tree: counts come from tiles, and points are looked at only where a window's edge cuts a tile.

The aggregate tree is the tiles table with ``shown``: of the points below a tile, how many have lod <= 0, lod <= 1, and so on.
A table of windows walks down it level by level. A pair of a window and a tile ends where the tile lies outside, or wholly inside, when
``shown`` says all that can be asked about it; only children of tiles on the edge are met next. A window that is sure to have
its number of points leaves the walk, so one over a whole run is done at the root. What is met grows with the edges of the windows, not
with their areas.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakfield.functions.scratch import written
from peakfield.operators.boxes import Box
from peakfield.operators.bounds import ancestor, ranges
from peakfield.operators.sampling import summarize_sized
from peakfield.operators.viewports import HOLDS, LEAVES, TASKS, opened

SIDES = [f"q_{a}_{e}" for a in ("mz", "rt") for e in ("min", "max")]
WINDOW = ["viewport_id", "run_id", "num_points", *SIDES]
MEETS = "mz_max >= q_mz_min AND mz_min <= q_mz_max AND rt_max >= q_rt_min AND rt_min <= q_rt_max"
INSIDE = "mz_min >= q_mz_min AND mz_max <= q_mz_max AND rt_min >= q_rt_min AND rt_max <= q_rt_max"
#: Parts at most that the points of one tile are dealt over.
SALTS = 16


def aggregate_tree(pyramid: DataFrame, base: int) -> DataFrame:
    """The tiles table (see tile_bounds_rollup) with ``shown``; shown[d] counts the points below the tile with lod <= d.

    The points are read once, into a row for each leaf and lod; these add up to all tiles above.
    """
    leaves = written(pyramid.groupBy("run_id", "leaf_depth", "tile_id", "lod").agg(*ranges(), F.count("*").alias("n_points")), "leaves")
    top = leaves.agg(F.max("leaf_depth")).first()[0] or 0
    up = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("leaf_depth"))))
    up = up.withColumn("tile_id", ancestor("depth", base))
    ends = [(F.min if e == "min" else F.max)(f"{a}_{e}").alias(f"{a}_{e}") for a in ("mz", "rt", "int") for e in ("min", "max")]
    shown = F.array(*(F.coalesce(F.sum(F.when(F.col("lod") <= d, F.col("n_points"))), F.lit(0)) for d in range(top + 1)))
    found = up.groupBy("run_id", "depth", "tile_id").agg(F.sum("n_points").alias("n_points"), F.max(F.col("leaf_depth") == F.col("depth")).alias("is_leaf"), *ends, shown.alias("shown"))
    return found.withColumn("parent_id", F.when(F.col("depth") > 0, F.expr(f"tile_id div {base}")))


def height_of(tree: DataFrame) -> int:
    return tree.agg(F.max("depth")).first()[0] or 0


@dataclass(frozen=True)
class Walk:
    """What a walk found: a row (WINDOW, depth, tile_id, inside, shown, chosen) for each tile that a window's points come from.

    Tiles of a window do not overlap. They are at the depth ``chosen`` that has enough points for the window, leaves above it, or wholly
    inside; a window that no depth has enough for has the tree's height as ``chosen``, which is all points. ``sums``, if the walk was asked for them,
    has (viewport_id, run_id, s0, s1, ...): the sums of ``shown`` of the tiles inside, which then have no rows of their own.
    """

    cover: DataFrame
    height: int
    tasks: int = 1
    sums: DataFrame | None = None


def _by_tile(points: DataFrame, tiles: DataFrame, key: list[str], tasks: int) -> DataFrame:
    """Points and windows' tiles joined by ``key``, over ``tasks`` tasks: neither side goes to the driver, and what counts is pairs, not the bytes that Spark would deal by."""
    return points.repartition(tasks, *key).join(tiles.repartition(tasks, *key).hint("merge"), key)


def tested(pyramid: DataFrame, edges: DataFrame, depth: int, base: int, tasks: int = TASKS) -> DataFrame:
    """(viewport_id, lod, n): points with lod <= ``depth`` inside windows. edges: (WINDOW, depth, tile_id), tiles at ``depth`` and leaves above it."""
    at = f"least({depth}, leaf_depth)"
    points = pyramid.where(F.col("lod") <= depth).select("run_id", F.expr(at).alias("depth"), ancestor(at, base).alias("tile_id"), "mz", "rt", "lod")
    return _by_tile(points, edges.select(*WINDOW, "depth", "tile_id"), ["run_id", "depth", "tile_id"], tasks).where(HOLDS).groupBy("viewport_id", "lod").agg(F.count("*").alias("n"))


def walk(tree: DataFrame, viewports: DataFrame, base: int, pyramid: DataFrame | None = None, summed: bool = False) -> Walk:
    """Windows (viewport_id, run_id, sides, num_points) down the aggregate tree; those with 0 points asked for, and all without ``pyramid``, go to the end.

    At each depth a window's tiles say how many points it has at least, by those inside, and at most. Only where num_points lies between
    are points read: those of the edge tiles that the depth shows. Each depth is written, so lineage stays one level long. Windows are
    dealt over tasks first, as a table of them may be one small file. ``summed``: tiles inside are met twice, once to be summed, and not written.
    """
    height, leaves = tree.agg(F.max("depth"), F.count_if("is_leaf")).first()
    height, tasks = height or 0, min(TASKS, leaves // LEAVES + 1)
    frontier = opened(viewports).repartition(tasks, "viewport_id").withColumn("parent_id", F.lit(None).cast("long"))
    found: list[DataFrame] = []
    sums: list[DataFrame] = []
    stay: DataFrame | None = None
    for depth in range(height + 1):
        tiles = tree.where(F.col("depth") == depth).select("run_id", "parent_id", "tile_id", "is_leaf", "shown", *(f"{a}_{e}" for a in ("mz", "rt") for e in ("min", "max")))
        met = frontier.join(tiles, ["run_id", "parent_id"]) if depth else frontier.drop("parent_id").join(tiles.drop("parent_id"), "run_id")
        met = met.where(MEETS).select(*WINDOW, F.lit(depth).alias("depth"), "tile_id", "is_leaf", F.expr(INSIDE).alias("inside"), "shown")
        if summed:
            sums.append(written(met.where("inside").groupBy("viewport_id", "run_id").agg(*(F.sum(F.col("shown")[d]).alias(f"s{d}") for d in range(height + 1))), "sums"))
            met = met.where("NOT inside")
        met = written(met, "met")
        cover = met if stay is None else stay.unionByName(met)
        enough = None
        if pyramid is not None and depth < height:
            at = F.col("shown")[depth]
            sure, edge = (F.coalesce(F.sum(F.when(F.col("inside") == x, at)), F.lit(0)) for x in (True, False))
            state = written(cover.where("num_points > 0").groupBy("viewport_id", "num_points").agg(sure.alias("sure"), edge.alias("edge")), "state")
            between = state.where("sure < num_points AND sure + edge >= num_points").select("viewport_id")
            counts = tested(pyramid, cover.where("NOT inside").join(between, "viewport_id", "left_semi"), depth, base, tasks).groupBy("viewport_id").agg(F.sum("n").alias("n"))
            enough = written(state.join(counts, "viewport_id", "left").where("sure + coalesce(n, 0) >= num_points").select("viewport_id"), "enough")
            found.append(cover.join(enough, "viewport_id", "left_semi").withColumn("chosen", F.lit(depth)))
            cover, met = (x.join(enough, "viewport_id", "left_anti") for x in (cover, met))
        stay = written(cover.where("inside OR is_leaf"), "stay")
        frontier = met.where("NOT inside AND NOT is_leaf").select(*WINDOW, F.col("tile_id").alias("parent_id"))
        if frontier.isEmpty():
            break
    found.append(stay.withColumn("chosen", F.lit(height)))
    return Walk(written(reduce(DataFrame.unionByName, found).drop("is_leaf"), "cover"), height, tasks, reduce(DataFrame.unionByName, sums) if sums else None)


def window_counts(pyramid: DataFrame, tree: DataFrame, viewports: DataFrame, base: int) -> DataFrame:
    """(viewport_id, run_id, depth, n_points): how many points of each window each depth offers, as ``points_per_level`` counts them.

    Of all points, only those of the leaves that edges cut are looked at.
    """
    w = walk(tree, viewports, base, summed=True)
    each = F.array(*(F.col(f"s{d}") - (F.col(f"s{d - 1}") if d else 0) for d in range(w.height + 1)))
    inside = w.sums.select("viewport_id", "run_id", F.posexplode(each).alias("lod", "n"))
    names = viewports.select("viewport_id", "run_id")
    cut = tested(pyramid, w.cover, w.height, base, w.tasks).join(names, "viewport_id").select("viewport_id", "run_id", "lod", "n")
    counts = inside.unionByName(cut).groupBy("viewport_id", "run_id", "lod").agg(F.sum("n").alias("n")).where("n > 0")
    upto = F.sum("n").over(Window.partitionBy("viewport_id", "run_id").orderBy("lod"))  # a row for each depth
    return counts.select("viewport_id", "run_id", F.col("lod").alias("depth"), upto.alias("n_points"))


def window_points(pyramid: DataFrame, found: Walk, base: int) -> DataFrame:
    """(viewport_id, num_points, the pyramid's columns): the points of each window that its chosen depth shows; the exact test is left to edge tiles.

    Points meet tiles one depth of tiles at a time, and of each only as many levels are read as some window there has chosen.
    """
    parts = []
    depths = found.cover.groupBy("depth", "run_id", "tile_id").agg(F.max("chosen").alias("most")).groupBy("depth").agg(F.max("most").alias("most"), F.count("*").alias("tiles"))
    for row in depths.orderBy("depth").collect():  # a row for each depth
        salts = max(1, min(SALTS, found.tasks // row["tiles"]))  # few tiles would be few tasks
        tiles = found.cover.where(F.col("depth") == row["depth"]).select("run_id", F.col("tile_id").alias("_tile"), "viewport_id", "num_points", *SIDES, "inside", "chosen")
        tiles = tiles.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        points = pyramid.where((F.col("lod") <= row["most"]) & (F.col("leaf_depth") >= row["depth"])).withColumn("_tile", ancestor(row["depth"], base))
        points = points.withColumn("_salt", F.pmod("point_id", F.lit(salts).cast("long")))
        joined = _by_tile(points, tiles, ["run_id", "_tile", "_salt"], found.tasks).where(f"lod <= chosen AND (inside OR ({HOLDS}))")
        parts.append(joined.select("viewport_id", "num_points", *pyramid.columns))
    if not parts:
        return pyramid.where("false").select(*(F.lit(None).cast(t).alias(c) for c, t in dict(found.cover.dtypes).items() if c in ("viewport_id", "num_points")), *pyramid.columns)
    return reduce(DataFrame.unionByName, parts)


def walk_viewports(pyramid: DataFrame, tree: DataFrame, viewports: DataFrame, base: int, strategy: str = "WeightedStriding") -> DataFrame:
    """query_viewports by a walk: the same points, with no more tiles and levels read than the windows need."""
    found = walk(tree, viewports, base, pyramid)
    whole, some = (replace(found, cover=found.cover.where(x)) for x in ("num_points = 0", "num_points > 0"))
    sizes = some.cover.groupBy("viewport_id", "num_points").agg(F.sum(F.col("shown")[F.col("chosen")]).alias("rows"))  # all of an edge tile, so no fewer than there are
    shown = summarize_sized(window_points(pyramid, some, base), "num_points", strategy, ["viewport_id"], sizes)
    return window_points(pyramid, whole, base).unionByName(shown)  # of whole windows no order is needed


def query_runs(pyramid: DataFrame, tree: DataFrame, base: int, box: Box, n: int, strategy: str = "WeightedStriding") -> DataFrame:
    """query_viewport for every run: about n points of each inside ``box``, each run at a depth of its own."""
    sides = {f"{a}_{e}": getattr(box, f"{a}_{e}") for a in ("mz", "rt") for e in ("min", "max")}
    asked = tree.where("depth = 0").select(F.col("run_id").alias("viewport_id"), "run_id", *(F.lit(v).cast("double").alias(k) for k, v in sides.items()), F.lit(n).alias("num_points"))
    return walk_viewports(pyramid, tree, asked, base, strategy).select(*pyramid.columns)
