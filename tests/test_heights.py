"""Trees of a given height: leaves hold what is left, all points stay, and the summaries are those of a full build."""

import pytest

from peakfield.functions.points import POINT
from peakfield.operators import pyramid, tiling
from peakfield.streaming import compact, ingest
from test_compaction import cloud, table

CAPACITY, HEIGHT = 5, 1
COLUMNS = ["tile_id", "leaf_depth", "lod"]


def batch(row):
    return row[1] // 2 % 3


def imported(spark, tmp_path, rows, strategy):
    for k in range(3):
        spark.createDataFrame([r for r in rows if batch(r) == k], POINT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest_stream(spark, f"{tmp_path}/in", POINT, f"{tmp_path}/out", f"{tmp_path}/at", capacity=CAPACITY, strategy=strategy, height=HEIGHT).awaitTermination()
    return f"{tmp_path}/out"


def full(spark, rows, height, strategy):
    df = spark.createDataFrame(rows, POINT)
    return pyramid.levels(tiling.tile(df, ingest.FAN_OUT, CAPACITY, height), ingest.FAN_OUT, CAPACITY, height, strategy)


@pytest.mark.parametrize("strategy", ["IntensityCutoff", "WeightedStriding"])
def test_batches_and_their_compaction_keep_to_the_height(spark, tmp_path, strategy):
    rows = cloud(1500, 1)
    out = imported(spark, tmp_path, rows, strategy)
    joined = ingest.joined_tree(spark, out, CAPACITY, strategy=strategy)
    assert table(joined, "leaf_depth") == sorted((run, i, HEIGHT + 1) for run, i, *_ in rows)
    sizes = [r["count"] for r in joined.groupBy("tile_id").count().collect()]
    assert len(sizes) == 24 and max(sizes) == 63  # over capacity, and none is lost
    mine = [r for r in rows if batch(r) == 1]
    want = [(run, i, lod + 1) for run, i, lod in table(full(spark, mine, HEIGHT, strategy), "lod")]
    got = {(run, i): lod for run, i, lod in table(joined, "lod")}
    assert all(got[run, i] in ((lod,) if lod > 1 else (0, 1)) for run, i, lod in want)
    got = compact.compacted(spark, out, CAPACITY, strategy=strategy, height=HEIGHT)
    assert table(got, *COLUMNS) == table(full(spark, rows, HEIGHT, strategy), *COLUMNS)


def test_large_leaves_are_summarized_over_tasks(spark, monkeypatch):
    """The same points rise, however many rows a window's partition may have."""
    rows = cloud(600, 6)
    want = table(full(spark, rows, HEIGHT, "WeightedStriding"), *COLUMNS)
    monkeypatch.setattr(pyramid, "WINDOW_ROWS", 100)
    tiled = tiling.tile(spark.createDataFrame(rows, POINT), ingest.FAN_OUT, CAPACITY, HEIGHT)
    assert table(pyramid.levels(tiled, ingest.FAN_OUT, CAPACITY, HEIGHT, "WeightedStriding", 75), *COLUMNS) == want


def test_the_least_height_that_holds_the_points():
    assert [tiling.height_for(n, 5, 8) for n in (0, 5, 6, 40, 41)] == [(0, 0), (0, 5), (1, 1), (1, 5), (2, 1)]
    assert tiling.height_for(1000, 5, 8, 1) == (1, 125)
