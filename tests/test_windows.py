"""Tables of windows by cells: the points that a plain test finds, without a row that is written for each point and window."""

import math
import random

import pytest

from peakfield.functions.points import POINT
from peakfield.operators import bounds, pyramid, sampling, tiling, viewports, walk
from peakfield.sources import store

CAPACITY, HEIGHT = 10, 3
ASKED = "viewport_id long, run_id string, mz_min double, mz_max double, rt_min float, rt_max float, num_points int"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """(points, aggregate tree, fan-out): two runs, many points at one rt."""
    rnd = random.Random(8)
    rows = [("a", i, 0, rnd.expovariate(0.01), float(rnd.choice([7, 7, rnd.randrange(1000)])), float(rnd.randrange(50))) for i in range(1200)]
    rows += [("b", i, 0, rnd.random() * 9, rnd.random(), float(rnd.randrange(9))) for i in range(90)]
    df = spark.createDataFrame(rows, POINT)
    _, fan_out = tiling.tree_config(1200, CAPACITY, HEIGHT)
    levels = pyramid.levels(tiling.tile(df, fan_out, CAPACITY, HEIGHT), fan_out, CAPACITY, HEIGHT, "IntensityCutoff")
    path = str(tmp_path_factory.mktemp("store"))
    store.write_store(levels, walk.aggregate_tree(levels, fan_out), path)
    return *store.open_store(spark, path), fan_out


def asked(spark, n, seed, counts=(0, 1, 9, 40)):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        x, y = rnd.random() * 300, rnd.random() * 900
        rows.append((i, "a", x, x + rnd.choice([1.0, 90.0, 900.0]), y, y + rnd.choice([1.0, 300.0, 900.0]), rnd.choice(counts)))
    rows += [(n, "b", 0.0, 0.0, 0.0, 0.0, 30), (n + 1, "a", None, 90.0, 7.0, 7.0, 0), (n + 2, "a", 90.0, 50.0, 1.0, 9.0, 5), (n + 3, "a", 90.0, 50.0, 9.0, 1.0, 0), (n + 4, "none", 0.0, 0.0, 0.0, 0.0, 0)]
    rows += [(n + 5, "a", 0.0, 0.0, 7.0, 7.0, None), (n + 6, "a", math.nan, math.nan, 7.0, 7.0, 0)]
    return spark.createDataFrame(rows, ASKED)


def ids(df):
    return sorted((r["viewport_id"], r["run_id"], r["point_id"]) for r in df.collect())


def plain(points, windows):
    return viewports.opened(windows).join(points, "run_id").where(viewports.HOLDS)


def test_points_of_windows_are_those_of_a_plain_test(spark, stored, monkeypatch):
    """... and no row is made for each window and tile."""
    odd = [("a", 5000, 0, None, 7.0, 99.0), ("a", 5001, 0, 50.0, None, 99.0), ("a", 5002, 0, math.nan, 7.0, 99.0)]
    points, windows = stored[0].select(*POINT.names).unionByName(spark.createDataFrame(odd, POINT)), asked(spark, 60, 1)
    points = tiling.tile(points, stored[2], CAPACITY, HEIGHT)
    monkeypatch.setattr(viewports, "viewport_tiles", lambda *a: pytest.fail("windows meet tiles"))
    got = viewports.viewport_points(points, bounds.tile_bounds(points), windows)
    assert got.columns == ["viewport_id", "num_points", *points.columns]
    assert ids(got) == ids(plain(points, windows)) and got.count()


@pytest.mark.parametrize("strategy", ["IntensityCutoff", "WeightedStriding", "UniformStriding"])
@pytest.mark.parametrize("most", [1 << 20, 30])
def test_windows_are_summarized_alike_whatever_their_size(spark, stored, strategy, most, monkeypatch):
    points, tree, fan_out = stored
    windows = asked(spark, 30, 2)
    inside = plain(points, windows).where("num_points > 0")
    upto = {}
    for r in inside.groupBy("viewport_id", "num_points", "lod").count().orderBy("lod").collect():
        n, depth = upto.get(r["viewport_id"], (0, None))
        n += r["count"]
        upto[r["viewport_id"]] = n, r["lod"] if depth is None and n >= r["num_points"] else depth
    depths = spark.createDataFrame([(i, HEIGHT if d is None else d) for i, (_, d) in upto.items()], "viewport_id long, depth int")
    shown = inside.join(depths, "viewport_id").where("lod <= depth").select("viewport_id", "num_points", *points.columns)
    want = ids(sampling.summarize(shown, "num_points", strategy, ["viewport_id"])) + ids(plain(points, windows).where("num_points = 0"))
    monkeypatch.setattr(sampling, "WINDOW_ROWS", most)
    assert ids(viewports.query_viewports(points, bounds.tile_bounds(points), windows, strategy)) == sorted(want)
    assert ids(walk.walk_viewports(points, tree, windows.where("num_points IS NOT NULL"), fan_out, strategy)) == sorted(want)


@pytest.mark.parametrize("by", ["join", "walk"])
def test_points_of_windows_are_not_written(spark, stored, by, monkeypatch):
    """Of windows over all there is only what each depth counts, not a row for each of their points."""
    points, tree, fan_out = stored
    windows = spark.range(40).selectExpr("id AS viewport_id", "'a' AS run_id", "0.001D AS mz_min", "0D AS mz_max", "0F AS rt_min", "0F AS rt_max", "cast(if(id < 20, 0, 5) AS int) AS num_points")
    most, write = [0], viewports.written

    def counted(df, name):
        out = write(df, name)
        most[0] = max(most[0], out.count())
        return out

    for module in (viewports, walk, sampling):
        monkeypatch.setattr(module, "written", counted)
    got = viewports.query_viewports(points, bounds.tile_bounds(points), windows) if by == "join" else walk.walk_viewports(points, tree, windows, fan_out)
    assert got.count() == 20 * 5 + plain(points, windows).where("num_points = 0").count()
    assert most[0] < 20 * 1200
