"""The walk down the aggregate tree and the store by level: what they give, and what they leave unread."""

import glob
import random
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from peakfield.functions.points import POINT
from peakfield.operators import bounds, pyramid, tiling, viewports, walk
from peakfield.operators.boxes import Box, in_box
from peakfield.sources import store

CAPACITY, HEIGHT = 20, 3
ASKED = "viewport_id long, run_id string, mz_min double, mz_max double, rt_min float, rt_max float, num_points int"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """(path, points, aggregate tree, fan-out): two runs of unequal size, with many points at one rt."""
    rnd = random.Random(4)
    rows = [("a", i, 0, rnd.gauss(500, 90), float(rnd.choice([7, 7, rnd.randrange(1000)])), float(rnd.randrange(100))) for i in range(1500)]
    rows += [("b", i, 0, rnd.uniform(0, 9), rnd.random() * 3, float(rnd.randrange(9))) for i in range(130)]
    df = spark.createDataFrame(rows, POINT)
    _, fan_out = tiling.tree_config(1500, CAPACITY, HEIGHT)
    levels = pyramid.levels(tiling.tile(df, fan_out, CAPACITY, HEIGHT), fan_out, CAPACITY, HEIGHT, "IntensityCutoff")
    path = str(tmp_path_factory.mktemp("store"))
    store.write_store(levels, walk.aggregate_tree(levels, fan_out), path)
    return path, *store.open_store(spark, path), fan_out


def windows(spark, n, seed, most=60):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        run = "a" if rnd.random() < 0.7 else "b"
        size = rnd.choice([0.02, 0.3, 1.0])
        wide, long = (1000.0, 1000.0) if run == "a" else (9.0, 3.0)
        x, y = rnd.random() * wide, rnd.random() * long
        rows.append((i, run, x, x + size * wide, y, y + size * long, rnd.choice([0, 1, 7, 25, most])))
    rows += [(n, "a", 0.0, 0.0, 0.0, 0.0, 30), (n + 1, "b", None, None, 7.0, 7.0, 5), (n + 2, "none", 0.0, 0.0, 0.0, 0.0, 5), (n + 3, "a", 500.0, 0.0, 7.0, 7.0, 9)]
    return spark.createDataFrame(rows, ASKED)


def ids(df):
    return sorted((r["viewport_id"], r["point_id"]) for r in df.collect())


@pytest.mark.parametrize("strategy", ["IntensityCutoff", "WeightedStriding", "UniformSampling"])
def test_walk_gives_what_the_join_gives(spark, stored, strategy):
    _, points, tree, fan_out = stored
    asked = windows(spark, 60, 1)
    want = viewports.query_viewports(points, bounds.tile_bounds(points), asked, strategy)
    assert ids(walk.walk_viewports(points, tree, asked, fan_out, strategy)) == ids(want)


def test_counts_are_those_of_the_points(spark, stored):
    _, points, tree, fan_out = stored
    asked = windows(spark, 40, 2)
    got = {(r["viewport_id"], r["depth"]): r["n_points"] for r in walk.window_counts(points, tree, asked, fan_out).collect()}
    want = {}
    for w in asked.collect():
        box = Box(w["mz_min"], w["mz_max"], w["rt_min"], w["rt_max"])
        for r in bounds.points_per_level(in_box(points.where(F.col("run_id") == w["run_id"]), box)).collect():
            want[w["viewport_id"], r["depth"]] = r["n_points"]
    assert got == want


def test_only_edge_tiles_are_left_to_points(spark, stored):
    """A window's tiles do not overlap and hold all its points; those that are not inside are leaves that its edges cut."""
    _, points, tree, fan_out = stored
    asked = windows(spark, 30, 3)
    cover = walk.walk(tree, asked, fan_out).cover.collect()
    leaves = [r for r in tree.where("is_leaf").collect()]
    cut = set()
    for w in viewports.opened(asked).collect():
        for t in leaves:
            meets = t["run_id"] == w["run_id"] and t["mz_max"] >= w["q_mz_min"] and t["mz_min"] <= w["q_mz_max"] and t["rt_max"] >= w["q_rt_min"] and t["rt_min"] <= w["q_rt_max"]
            inside = t["mz_min"] >= w["q_mz_min"] and t["mz_max"] <= w["q_mz_max"] and t["rt_min"] >= w["q_rt_min"] and t["rt_max"] <= w["q_rt_max"]
            if meets and not inside:
                cut.add((w["viewport_id"], t["depth"], t["tile_id"]))
    assert {(r["viewport_id"], r["depth"], r["tile_id"]) for r in cover if not r["inside"]} == cut
    whole = [r for r in cover if r["inside"]]
    assert any(r["depth"] < 3 for r in whole)
    # the counts read no other leaf's points
    edges = spark.createDataFrame([(d, t) for d, t in {(r["depth"], r["tile_id"]) for r in cover if not r["inside"]}], "leaf_depth int, tile_id long")
    few = points.join(edges, ["leaf_depth", "tile_id"], "left_semi").select(points.columns)
    assert few.count() < points.count()
    assert sorted(map(tuple, walk.window_counts(few, tree, asked, fan_out).collect())) == sorted(map(tuple, walk.window_counts(points, tree, asked, fan_out).collect()))


def test_a_thousand_whole_runs_open_the_first_level_alone(spark, stored, tmp_path):
    path, _, tree, fan_out = stored
    asked = spark.range(1000).selectExpr("id AS viewport_id", "if(id % 3 = 0, 'b', 'a') AS run_id", "0D AS mz_min", "0D AS mz_max", "0F AS rt_min", "0F AS rt_max", "cast(id % 20 + 1 AS int) AS num_points")
    want = ids(walk.walk_viewports(store.open_store(spark, path)[0], tree, asked, fan_out, "IntensityCutoff"))
    shutil.copytree(path, f"{tmp_path}/s")
    for level in glob.glob(f"{tmp_path}/s/points/lod=*"):
        if not level.endswith("lod=0"):
            shutil.rmtree(level)
    shallow = store.open_store(spark, f"{tmp_path}/s")[0]
    assert ids(walk.walk_viewports(shallow, tree, asked, fan_out, "IntensityCutoff")) == want
    assert len(want) == sum(i % 20 + 1 for i in range(1000))
    # and the scan of a depth is one of its folders
    plan = store.open_store(spark, path)[0].where("lod <= 1 AND mz > 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lod" in plan and "PushedFilters: [IsNotNull(mz), GreaterThan(mz" in plan


def test_row_groups_follow_the_curve(spark, tmp_path):
    """A small window of one run meets few row groups of a level."""
    df = spark.range(200_000).selectExpr("if(id % 2 = 0, 'a', 'b') AS run_id", "id AS point_id", "0 AS meta1", "rand(1) * 1000 AS mz", "cast(rand(2) * 1000 AS float) AS rt", "1D AS intensity", "0L AS tile_id", "0 AS leaf_depth", "1 AS lod")
    tiles = bounds.dataset_summary(df).withColumn("depth", F.lit(0))
    many = spark.newSession()
    many.conf.set("spark.sql.shuffle.partitions", 40)
    many.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    df.write.parquet(f"{tmp_path}/df")
    store.write_store(many.read.parquet(f"{tmp_path}/df"), many.createDataFrame(tiles.toPandas()), str(tmp_path))
    meets = groups = 0
    for file in glob.glob(f"{tmp_path}/points/lod=1/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            groups += 1
            meets += all(stats[c].max >= lo and stats[c].min <= hi for c, lo, hi in (("mz", 400, 450), ("rt", 400, 450), ("run_id", "a", "a")))
    assert groups >= 30 and meets <= groups // 8


def test_query_runs_takes_each_run_by_itself(spark, stored):
    _, points, tree, fan_out = stored
    box = Box(mz_min=1.0)
    got = walk.query_runs(points, tree, fan_out, box, 15, "IntensityCutoff")
    assert {r["run_id"]: r["count"] for r in got.groupBy("run_id").count().collect()} == {"a": 15, "b": 15}
    for run in "ab":
        want = pyramid.query_viewport(points.where(F.col("run_id") == run), box, 15, "IntensityCutoff")
        assert {r["point_id"] for r in got.where(F.col("run_id") == run).collect()} == {r["point_id"] for r in want.collect()}


def test_nothing_to_walk(spark, stored):
    _, points, tree, fan_out = stored
    none = spark.createDataFrame([], ASKED)
    assert walk.walk_viewports(points, tree, none, fan_out).count() == 0
    assert walk.window_counts(points, tree, none, fan_out).count() == 0
