"""Compaction of batch trees: what overlaps is built again, what does not stays, and windows find the same points."""

import random

import pytest
from pyspark.sql import functions as F

from peakfield.functions.points import POINT
from peakfield.operators import bounds, pyramid, tiling, walk
from peakfield.operators.boxes import Box
from peakfield.streaming import compact, ingest

CAPACITY = 30


def imported(spark, tmp_path, rows, batch):
    """rows, dealt over files by ``batch`` (row -> number), each a batch with a tree."""
    df = spark.createDataFrame(rows, POINT)
    for k in sorted({batch(r) for r in rows}):
        spark.createDataFrame([r for r in rows if batch(r) == k], POINT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest_stream(spark, f"{tmp_path}/in", POINT, f"{tmp_path}/out", f"{tmp_path}/at", capacity=CAPACITY, strategy="IntensityCutoff").awaitTermination()
    return df, f"{tmp_path}/out"


def cloud(n, seed, runs="a"):
    rnd = random.Random(seed)
    return [(runs[i % len(runs)], i, 0, rnd.random() * 100, float(rnd.randrange(1000)), float(rnd.randrange(50))) for i in range(n)]


def table(df, *columns):
    return sorted(map(tuple, df.select("run_id", "point_id", *columns).collect()))




def test_batches_that_overlap_throughout_become_a_full_build(spark, tmp_path):
    rows = cloud(1500, 1, "ab")
    df, out = imported(spark, tmp_path, rows, lambda r: r[1] // 2 % 3)
    got = compact.compacted(spark, out, CAPACITY, strategy="IntensityCutoff")
    height = 2  # 750 points in tiles of 30, by eights
    want = pyramid.levels(tiling.tile(df, ingest.FAN_OUT, CAPACITY, height), ingest.FAN_OUT, CAPACITY, height, "IntensityCutoff")
    assert table(got, "tile_id", "leaf_depth", "lod") == table(want, "tile_id", "leaf_depth", "lod")
    assert sorted(map(tuple, bounds.points_per_level(got).collect())) == sorted(map(tuple, bounds.points_per_level(want).collect()))


def test_batches_in_order_are_left_alone(spark, tmp_path, monkeypatch):
    """Slices that share no more than an edge stay: nothing is tiled."""
    rows = cloud(1200, 2)
    _, out = imported(spark, tmp_path, rows, lambda r: int(r[4] // 250))
    monkeypatch.setattr(compact, "tile", lambda *a: pytest.fail("nothing overlaps"))
    got = compact.compacted(spark, out, CAPACITY, strategy="IntensityCutoff")
    assert table(got) == sorted((r[0], r[1]) for r in rows)
    check(spark, got, rows)


def check(spark, got, rows):
    """Every tile shows what it should, tiles of a depth do not overlap in rt and mz, and a window finds its points."""
    got = got.persist()
    tree = walk.aggregate_tree(got, ingest.FAN_OUT).collect()
    leaves = [t for t in tree if t["is_leaf"]]
    for i, a in enumerate(leaves):
        for b in leaves[i + 1 :]:
            if a["run_id"] == b["run_id"]:
                apart = a["rt_max"] <= b["rt_min"] or b["rt_max"] <= a["rt_min"] or a["mz_max"] <= b["mz_min"] or b["mz_max"] <= a["mz_min"]
                assert apart, (a, b)
    for t in tree:
        assert t["is_leaf"] or t["shown"][t["depth"]] >= min(CAPACITY, t["n_points"])
        assert not t["is_leaf"] or t["n_points"] <= CAPACITY
    top = got.where("lod = 0").groupBy("run_id").count().collect()
    assert all(r["count"] == CAPACITY for r in top)
    best = {run: sorted((r[5], r[1]) for r in rows if r[0] == run)[-CAPACITY:] for run in {r[0] for r in rows}}
    assert {(r["run_id"], r["point_id"]) for r in got.where("lod = 0").collect()} == {(run, i) for run, x in best.items() for _, i in x}
    box = Box(20.0, 70.0, 100.0, 800.0)
    inside = pyramid.query_viewport(got, box, 0)
    assert table(inside) == sorted((r[0], r[1]) for r in rows if 20 <= r[3] <= 70 and 100 <= r[4] <= 800)
    got.unpersist()


def test_only_what_overlaps_is_built_again(spark, tmp_path, monkeypatch):
    """Batches 0 to 3 in order, but the third begins inside the second; a late file brings a few old points; one run lies in one batch."""
    rows = cloud(2000, 3, "aab")
    late = {r[1] for r in rows if 40 <= r[4] < 60 and r[1] % 7 == 0}

    def batch(r):
        if r[0] == "b":
            return 1
        if r[1] in late:
            return 4
        return 2 if 450 <= r[4] < 500 and r[1] % 2 else int(r[4] // 250)

    _, out = imported(spark, tmp_path, rows, batch)
    tiled, tile = [], compact.tile

    def counted(df, *more):
        tiled.append(df.count())
        return tile(df, *more)

    monkeypatch.setattr(compact, "tile", counted)
    got = compact.compacted(spark, out, CAPACITY, strategy="IntensityCutoff")
    assert 0 < tiled[0] < 1000
    assert table(got) == sorted((r[0], r[1]) for r in rows)
    check(spark, got, rows)


def test_edges_may_be_shared(spark):
    """Slices at one rt, and slices that touch, are parts of their own; a slice inside another one is not."""
    rows = [("a", 0, 0, 0.0, 5.0), ("a", 0, 1, 5.0, 9.0), ("a", 1, 0, 5.0, 5.0), ("a", 2, 0, 9.0, 12.0), ("a", 2, 1, 10.0, 11.0), ("b", 0, -1, 1.0, 2.0)]
    points = spark.createDataFrame([(run, batch, s, rt) for run, batch, s, *ends in rows for rt in ends], "run_id string, batch int, slice long, rt float")
    got = {(r["run_id"], r["batch"], r["slice"]): (r["part"], r["n_slices"]) for r in compact.parts_of(points).collect()}
    assert got["a", 2, 0] == got["a", 2, 1] and got["a", 2, 0][1] == 2
    assert got["a", 0, 0][1] == got["a", 0, 1][1] == got["a", 1, 0][1] == got["b", 0, -1][1] == 1
    assert got["a", 0, 0][0] == 0 and got["a", 2, 0][0] == 3
