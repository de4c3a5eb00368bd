"""Operators on small hand-made frames, and the properties of tiles and levels."""

import base64
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from peakfield.functions.points import POINT, project_axes
from peakfield.functions.scratch import scratch_path
from peakfield.jobs.import_run import import_run
from peakfield.operators import boxes, bounds, ordering, pyramid, sampling, tiling, viewports
from peakfield.operators.boxes import Box
from peakfield.sources import mzml, records, store, text
from peakfield.streaming import ingest


@pytest.fixture(scope="module")
def cloud(spark):
    def make(n=3000, seed=0, runs=("a", "b"), weights=range(0, 50)):
        rnd = random.Random(seed)
        rows = [(runs[i % len(runs)], i, 0, rnd.random() * 100, float(rnd.randrange(40)), float(rnd.choice(weights))) for i in range(n)]
        return spark.createDataFrame(rows, POINT)

    return make


def walk(weights, n, stride=43):
    """Weighted striding as the described loop, written out."""
    rows = list(range(len(weights)))
    if len(rows) <= n:
        return set(rows)
    limit, total, taken = sum(weights) / n, 0.0, []
    while len(taken) < n:
        order = [i for r in range(min(stride, len(rows))) for i in range(r, len(rows), stride)]
        skipped = []
        for i in order:
            if len(taken) == n:
                break
            total += weights[rows[i]]
            if total >= limit - 1e-5:
                taken.append(rows[i])
                total -= limit
            else:
                skipped.append(rows[i])
        rows = skipped
    return set(taken)


@pytest.mark.parametrize(("weights", "n"), [([1] * 100, 7), ([0] * 200 + [1000], 20), ([0] * 90, 10), (list(range(120)), 119), ([5] * 10, 30), ([1, 900] + [1] * 300, 60), ([3], 1)])
@pytest.mark.parametrize("large", [True, False])
def test_weighted_striding(spark, weights, n, large):
    df = spark.createDataFrame([("r", i, 0, 1.0, 1.0, float(w)) for i, w in enumerate(weights)], POINT)
    assert {r.point_id for r in sampling.stride_weighted(df, n, large=large).collect()} == walk(weights, n)


def test_weighted_striding_over_buckets(spark, monkeypatch):
    """Running sums that cross buckets give what one window would."""
    rnd = random.Random(1)
    weights = [rnd.randrange(100) for _ in range(900)]
    monkeypatch.setattr(sampling, "BUCKET", 64)
    df = spark.createDataFrame([("r", i, 0, 1.0, 1.0, float(w)) for i, w in enumerate(weights)], POINT)
    assert {r.point_id for r in sampling.stride_weighted(df, 111).collect()} == walk(weights, 111)


@pytest.mark.parametrize("strategy", [*sampling.STRATEGIES, lambda pdf, n: pdf.head(n)])
@pytest.mark.parametrize("n", [1, 40, 10_000])
def test_samplers_return_n_without_repeats(cloud, strategy, n):
    got = Counter(r.run_id for r in sampling.summarize(cloud(300, weights=range(1, 9)), n, strategy).distinct().collect())
    assert got == {"a": min(n, 150), "b": min(n, 150)}


def test_unknown_strategy(cloud):
    with pytest.raises(ValueError, match="no strategy"):
        sampling.summarize(cloud(3), 1, "Best")


def test_weighted_sampling(spark, cloud):
    got = sampling.sample_weighted(cloud(400), 100, 3).collect()
    assert Counter(r.run_id for r in got) == {"a": 100, "b": 100}
    with pytest.raises(ValueError, match="sum to 0"):
        sampling.sample_weighted(spark.createDataFrame([("r", 1, 0, 1.0, 1.0, 0.0)], POINT), 1)


def test_reservoir_prefers_weight(spark):
    df = spark.createDataFrame([("r", i, 0, 1.0, 1.0, 100.0 if i < 100 else 1.0) for i in range(1000)], POINT)
    heavy = sum(r.point_id < 100 for s in range(5) for r in sampling.sample_reservoir(df, 50, s).collect())
    assert 0.85 * 250 < heavy  # about 100/109 of the first draws


def test_top_takes_the_later_of_equals(spark):
    df = spark.createDataFrame([("r", i, 0, 1.0, 1.0, 5.0) for i in range(9)], POINT)
    assert {r.point_id for r in sampling.top_intensity(df, 2).collect()} == {7, 8}


def test_order(cloud):
    df = cloud(1000)
    ids = ordering.global_index(df, ["mz", "point_id"]).collect()
    assert [r.point_id for r in sorted(ids, key=lambda r: r.idx)] == [r.point_id for r in sorted(ids, key=lambda r: (r.mz, r.point_id))]
    assert sorted(r.idx for r in ids) == list(range(1000))
    sizes = Counter((r.run_id, r.chunk) for r in ordering.chunk_split(df, ["run_id"], ["rt", "point_id"], 7).collect())
    assert sizes == {(run, k): 72 if k < 6 else 68 for run in "ab" for k in range(7)}
    assert ordering.limit_points(df, 0, ["point_id"]).count() == 1000


def test_tree_config():
    assert tiling.tree_config(8192) == (1, 1)
    assert tiling.tree_config(8193) == (2, 2)
    assert tiling.tree_config(8192 * 81) == (81, 3)  # no root rounded up
    assert tiling.tree_config(8192 * 82) == (82, 4)
    assert tiling.tree_config(0) == (1, 1)


@pytest.mark.parametrize(("n", "capacity", "height"), [(3000, 100, 3), (3000, 64, 2), (90, 100, 4), (1000, 499, 4)])
def test_tiles_and_levels(cloud, n, capacity, height):
    df = cloud(n)
    _, fan_out = tiling.tree_config(tiling.largest_run(df), capacity, height)
    rows = pyramid.build_pyramid(df, capacity, height).collect()
    assert sorted(r.point_id for r in rows) == list(range(n))
    leaf = defaultdict(list)
    for r in rows:
        leaf[r.run_id, r.leaf_depth, r.tile_id].append(r)
        assert 0 <= r.lod <= r.leaf_depth
    assert max(map(len, leaf.values())) <= capacity
    for depth in range(height):  # what an inner tile shows comes from what its children show, and fills it
        shown, below = Counter(), Counter()
        for r in rows:
            if r.leaf_depth > depth:
                tile = (r.run_id, r.tile_id // fan_out ** (r.leaf_depth - depth))
                shown[tile] += r.lod <= depth
                below[tile] += r.lod <= depth + 1
        assert all(shown[t] == min(capacity, below[t]) for t in below)


def test_rolled_up_bounds(cloud):
    df = cloud(2000)
    tiled = tiling.tile(df, 3, 120, 3)
    tiles = {(r.run_id, r.depth, r.tile_id): r for r in bounds.tile_bounds_rollup(bounds.tile_bounds(tiled), 3).collect()}
    for r in tiled.collect():
        for depth in range(r.leaf_depth + 1):
            t = tiles[r.run_id, depth, r.tile_id // 3 ** (r.leaf_depth - depth)]
            assert t.mz_min <= r.mz <= t.mz_max and t.rt_min <= r.rt <= t.rt_max and t.int_min <= r.intensity <= t.int_max
    for t in tiles.values():
        assert (t.parent_id is None) == (t.depth == 0)
        if t.depth:
            up = tiles[t.run_id, t.depth - 1, t.parent_id]
            assert up.mz_min <= t.mz_min and up.mz_max >= t.mz_max and up.n_points >= t.n_points and not up.is_leaf
    root = bounds.dataset_summary(df).collect()
    assert all(tiles[r.run_id, 0, 0].n_points == r.point_count for r in root)


@pytest.mark.parametrize("n", [0, 5, 60, 10**6])
def test_viewports_agree_with_single_ones(spark, cloud, n):
    df = cloud(1500, runs=("a",))
    made = pyramid.build_pyramid(df, 100, 2, "IntensityCutoff")
    box = Box(10.0, 70.0, 0.0, 30.0)
    single = {r.point_id for r in pyramid.query_viewport(made, box, n, "IntensityCutoff").collect()}
    asked = spark.createDataFrame([(1, "a", 10.0, 70.0, 0.0, 30.0, n), (2, "a", 200.0, 300.0, 0.0, 0.0, n)], "viewport_id long, run_id string, mz_min double, mz_max double, rt_min float, rt_max float, num_points int")
    many = viewports.query_viewports(made, bounds.tile_bounds(made), asked).collect()
    assert {r.point_id for r in many} == single and {r.viewport_id for r in many} <= {1}
    inside = boxes.in_box(df, box).count()
    assert len(single) == (min(n, inside) if n else inside)
    strided = viewports.query_viewports(made, bounds.tile_bounds(made), asked, "WeightedStriding").count()
    assert strided == len(single)


def test_box_edges_are_floats(spark):
    df = spark.createDataFrame([("r", 1, 0, 5.0, 0.1, 1.0)], POINT)
    assert boxes.in_box(df, Box(5.0, 5.0, 0.1, 0.1)).count() == 1
    assert boxes.in_box(df, Box(0, 0, 0, 0)).count() == 1
    assert boxes.in_box(df, boxes.open_box("", "4.9", None, " ")).count() == 0
    asked = spark.createDataFrame([(500.0, 0.0, 1.0, 2.0, 1), (1.0, 2.0, 3.0, 2.0, 1), (1.0, None, 1.0, 2.0, 1), (1.0, 1.0, 2.0, 2.0, 0)], "mz_min double, mz_max double, rt_min double, rt_max double, num_points int")
    assert [r.reason for r in boxes.validated(asked).collect()] == ["mz inverted", "rt inverted", "missing mz_max", None]


def test_csv(spark, tmp_path):
    files = {"header": "m/z,RT,intensity,meta1\n500.25,12.5,1043.0,0\n", "plain": "500.25,12.5,0.5,3\n500,1,2,4\n", "quoted": '"MZ","rt","i","m"\n"1.5","2","3","4"\n', "empty": ""}
    for name, content in files.items():
        (tmp_path / f"{name}.csv").write_text(content)
    count = {name: text.read_points_csv(spark, f"{tmp_path}/{name}.csv").count() for name in files}
    assert count == {"header": 1, "plain": 2, "quoted": 1, "empty": 0}
    (tmp_path / "bad.csv").write_text("1,2,3,4\nx,2,3,4\n1,2,3\n")
    with pytest.raises(Exception, match="is no number"):
        text.read_points_csv(spark, f"{tmp_path}/bad.csv").collect()
    assert text.read_points_csv(spark, f"{tmp_path}/bad.csv", "drop").count() == 1
    assert sorted(r.reason for r in text.bad_lines(spark, f"{tmp_path}/bad.csv").collect()) == ["meta1", "mz"]


def test_export_and_json(cloud, spark):
    df, path = cloud(500), scratch_path(spark, "out")
    n = text.export_csv(df, path, Box(mz_max=50.0))
    assert n == boxes.in_box(df, Box(mz_max=50.0)).count() == store.load(spark, path, "csv").count()
    first = text.to_json_rows(df, limit=1).first().value
    assert first.startswith("[0,0,") and first.count(",") == 4
    assert text.to_json_rows(df, extras=False).first().value.count(",") == 2
    assert project_axes(df, False).columns == ["mz", "rt", "intensity"]


def element(index, level, arrays, rt="12.5"):
    body = "".join("<binaryDataArray>" + "".join(f'<cvParam accession="{t}"/>' for t in terms) + f"<binary>{base64.b64encode(data).decode()}</binary></binaryDataArray>" for terms, data in arrays)
    stated = f'<cvParam accession="{mzml.MS_LEVEL}" value="{level}"/>' if level is not None else ""
    return f'<spectrum index="{index}" id="s{index}">{stated}<scanList><scan><cvParam accession="{mzml.SCAN_START}" value="{rt}" unitName="minute"/></scan></scanList><binaryDataArrayList>{body}</binaryDataArrayList></spectrum>'


def packed(values, wide, small, axis):
    raw = np.array(values, "<f8" if wide else "<f4").tobytes()
    return [axis, mzml.FLOAT_64 if wide else mzml.FLOAT_32, mzml.ZLIB if small else mzml.RAW], zlib.compress(raw) if small else raw


def test_mzml(spark, tmp_path):
    spectra = []
    for k, (wide, small) in enumerate([(True, True), (True, False), (False, True), (False, False)]):
        spectra.append(element(k, [1, 2, None, 1][k], [packed([500.5, 501.5, 502.5], wide, small, mzml.MZ_ARRAY), packed([0.5, 1.0, 8.0], wide, small, mzml.INTENSITY_ARRAY), (["MS:1000516", mzml.FLOAT_32], b"\0" * 4)]))
    spectra.append(element(4, 1, [packed([], True, False, mzml.MZ_ARRAY), packed([], True, False, mzml.INTENSITY_ARRAY)]))
    spectra.append(element(5, 1, [packed([1.0], True, False, mzml.MZ_ARRAY), packed([1.0, 2.0], True, False, mzml.INTENSITY_ARRAY)]))
    spectra.append(element(6, 1, [([mzml.MZ_ARRAY], b"12345678"), packed([1.0], True, False, mzml.INTENSITY_ARRAY)]))
    spectra.append(element(7, 1, [packed([1.0], True, False, mzml.MZ_ARRAY)]))
    (tmp_path / "a.mzML").write_text('<?xml version="1.0"?>\n<indexedmzML><mzML><run><spectrumList count="8">' + "\n".join(spectra) + "</spectrumList></run></mzML></indexedmzML>")
    read = mzml.read_mzml_spectra(spark, f"{tmp_path}/a.mzML")
    assert {(r.spectrum_index, r.ms_level, r.rt, r.rt_unit) for r in read.collect()} == {(k, [1, 2, None, 1, 1, 1, 1, 1][k], 12.5, "minute") for k in range(8)}
    points = mzml.decode_spectra(read).collect()
    assert {(r.spectrum_index, r.position, r.mz, r.intensity) for r in points} == {(k, i, 500.5 + i, [0.5, 1.0, 8.0][i]) for k in range(4) for i in range(3)}
    assert {r.spectrum_index: r.reason for r in mzml.quarantine(read).collect()} == {5: "arrays of different length", 6: "no bit width", 7: "missing array"}
    kept = boxes.filter_ms_level(read)
    assert sorted(r.spectrum_index for r in kept.collect()) == [0, 2, 3, 4, 5, 6, 7]
    out = scratch_path(spark, "store")
    import_run(spark, f"{tmp_path}/a.mzML", out, 4, 2)
    df, tiles = store.open_store(spark, out)
    assert df.count() == 6 and sorted(r.point_id for r in df.collect()) == list(range(6))
    assert tiles.where("depth = 0").first().n_points == 6
    assert store.load(spark, f"{tmp_path}/a.mzML").count() == 12
    with pytest.raises(Exception, match="(?i)exist"):
        store.copy_store(spark, out, out)


def test_records(spark, tmp_path):
    rows = [(500.25, 12.5, 1043.0, 0), (1.0, 0.1, 2.0, -7)]
    (tmp_path / "points.bin").write_bytes(b"".join(struct.pack(">dfdi", *r) for r in rows))
    got = records.read_point_records(spark, f"{tmp_path}/points.bin").orderBy("point_id").collect()
    assert [(r.mz, r.rt, r.intensity, r.meta1) for r in got] == [(a, struct.unpack("f", struct.pack("f", b))[0], c, d) for a, b, c, d in rows]
    assert [r.point_id for r in got] == [0, 1]


def test_record_files(spark, cloud, tmp_path):
    df, path = cloud(500), scratch_path(spark, "records")
    assert sum(r.n_points for r in records.write_point_records(df, path).collect()) == 500
    want = sorted((r.point_id, r.meta1, r.mz, r.rt, r.intensity) for r in df.collect())
    assert sorted(map(tuple, records.read_point_records(spark, path).collect())) == want
    for name, n in (("a", 3), ("b", 0), ("c", 2)):
        (tmp_path / f"{name}.bin").write_bytes(struct.pack(">dfdi", 1.0, 2.0, 3.0, n) * n)
    assert {(r.point_id, r.meta1) for r in records.read_point_records(spark, str(tmp_path)).collect()} == {(0, 3), (1, 3), (2, 3), (3, 2), (4, 2)}
    (tmp_path / "d.bin").write_bytes(b"x" * 30)
    with pytest.raises(Exception, match="partial record"):
        records.read_point_records(spark, str(tmp_path)).collect()


def test_stream_of_raw_files(spark, tmp_path):
    """Files are imported one by one; what cannot be read is kept aside."""
    (tmp_path / "csv").mkdir(), (tmp_path / "mzml").mkdir()
    (tmp_path / "csv/a.csv").write_text("m/z,RT,intensity,meta1\n1,2,3,4\n5,1,3,4\nx,2,3,4\n")
    (tmp_path / "csv/b.csv").write_text("9,9,9,9\n")
    good = [packed([500.5, 501.5], True, True, mzml.MZ_ARRAY), packed([0.5, 8.0], True, True, mzml.INTENSITY_ARRAY)]
    spectra = [element(0, 1, good), element(1, 2, good), element(2, 1, good[:1])]
    (tmp_path / "mzml/a.mzML").write_text("<mzML><run><spectrumList>" + "\n".join(spectra) + "</spectrumList></run></mzML>")
    got = {}
    for kind in ("csv", "mzml"):
        out = scratch_path(spark, "out")
        ingest.ingest_stream(spark, f"{tmp_path}/{kind}", None, out, scratch_path(spark, "offsets"), kind=kind).awaitTermination()
        points = spark.read.parquet(f"{out}/points").collect()
        got[kind] = sorted((r.run_id[-5:], r.point_id, r.mz) for r in points), [r.reason for r in spark.read.parquet(f"{out}/quarantine").collect()]
    assert got["csv"] == ([("a.csv", 0, 5.0), ("a.csv", 1, 1.0), ("b.csv", 0, 9.0)], ["mz"])
    assert got["mzml"] == ([(".mzML", 0, 501.5)], ["missing array"])
    with pytest.raises(ValueError, match="no kind"):
        ingest.ingest_stream(spark, str(tmp_path), None, "", "", kind="txt")


def test_joined_tree(spark, cloud):
    """Three batches below two common levels: each inner tile shows what it can of what its children show."""
    source, out, capacity, fan_out = scratch_path(spark, "in"), scratch_path(spark, "out"), 60, 2
    cloud(900, runs=("a",)).repartitionByRange(3, "point_id").write.parquet(source)
    ingest.ingest_stream(spark, source, POINT, out, scratch_path(spark, "offsets"), capacity=capacity, fan_out=fan_out).awaitTermination()
    made = ingest.joined_tree(spark, out, capacity, fan_out)
    rows = made.collect()
    assert sorted(r.point_id for r in rows) == list(range(900))
    for depth in range(max(r.leaf_depth for r in rows)):
        shown, below = Counter(), Counter()
        for r in rows:
            if r.leaf_depth > depth:
                at = r.tile_id // fan_out ** (r.leaf_depth - depth)
                shown[at] += r.lod <= depth
                below[at] += r.lod <= depth + 1
        assert all(shown[t] == min(capacity, below[t]) for t in below)
    assert pyramid.query_viewport(made, Box(), 50, "IntensityCutoff").count() == 50
    tiles = bounds.tile_bounds_rollup(bounds.tile_bounds(made), fan_out).where("depth = 0").collect()
    assert [(t.tile_id, t.n_points) for t in tiles] == [(0, 900)]


def test_whole_run_viewports_meet_each_tile_once(spark, cloud):
    made = tiling.tile(cloud(2000), 4, 30, 3)
    leaves = bounds.tile_bounds(made)
    asked = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0, 0.0, 0), (2, "a", 200.0, 300.0, 0.0, 0.0, 0), (3, "b", 20.0, 30.0, 5.0, 9.0, 0)], "viewport_id long, run_id string, mz_min double, mz_max double, rt_min float, rt_max float, num_points int")
    got = Counter((r.viewport_id, r.leaf_depth, r.tile_id) for r in viewports.viewport_tiles(leaves, asked).collect())
    tiles = leaves.collect()
    want = {(1, t.leaf_depth, t.tile_id) for t in tiles if t.run_id == "a"} | {(3, t.leaf_depth, t.tile_id) for t in tiles if t.run_id == "b" and t.mz_max >= 20 and t.mz_min <= 30 and t.rt_max >= 5 and t.rt_min <= 9}
    assert got == Counter(want)


def test_stream_is_idempotent(spark, cloud):
    source, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    df = cloud(800, runs=("a",))
    df.repartitionByRange(3, "point_id").write.parquet(source)
    for _ in range(2):  # a second run over the same checkpoint folder, and one without it, change nothing
        ingest.ingest_stream(spark, source, POINT, out, scratch_path(spark, "offsets"), capacity=100).awaitTermination()
        assert ingest.merged_summary(spark, out).collect() == bounds.dataset_summary(df).collect()
        assert spark.read.parquet(f"{out}/points").count() == 800
    assert ingest.root_summary(spark, out, 10).count() == 10
