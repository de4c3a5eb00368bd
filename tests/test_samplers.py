"""Sums and samples that do not hang on how rows are dealt, mergeable samples, and strategies for groups of any size."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from peakfield.functions.points import POINT
from peakfield.functions.sums import exact_sums
from peakfield.operators import bounds, pyramid, sampling
from peakfield.streaming import ingest


def cloud(spark, weights, runs="a"):
    return spark.createDataFrame([(runs[i % len(runs)], i, i % 5, i * 0.1, float(i), float(w)) for i, w in enumerate(weights)], POINT)


def ids(df):
    return sorted((r["run_id"], r["point_id"]) for r in df.collect())


@pytest.fixture(scope="module")
def uneven():
    rnd = random.Random(5)
    return [rnd.choice([1e-9, 0.1, 1 / 3, 7.7, 1e6]) * rnd.random() for _ in range(4000)]


def test_sums_are_the_same_in_any_order(spark, uneven):
    df = cloud(spark, [*uneven, -3.25, 0.0], "ab")
    got = {tuple(sorted(tuple(r) for r in exact_sums(x, ["run_id"], {"s": F.col("intensity")}).collect())) for x in (df.coalesce(1), df.repartition(64), df.repartition(7, "mz"), df.orderBy(F.desc("intensity")))}
    assert len(got) == 1
    for run, s in got.pop():
        assert s == pytest.approx(math.fsum(w for i, w in enumerate([*uneven, -3.25, 0.0]) if "ab"[i % 2] == run), rel=1e-15)


def test_sums_of_whole_numbers_are_exact(spark):
    rnd = random.Random(2)
    weights = [rnd.randrange(1 << 40) for _ in range(900)] + [0]
    row = bounds.axis_sums(cloud(spark, weights)).first()
    assert row["int_sum"] == sum(weights) and row["rt_sum"] == sum(range(901))
    assert exact_sums(cloud(spark, [0, 0]), ["run_id"], {"s": F.col("intensity")}).first()["s"] == 0


@pytest.mark.parametrize("large", [True, False])
def test_weighted_strides_over_fractions(spark, uneven, large, monkeypatch):
    """The points are the same for 1 and 64 partitions, and those of a walk with exact sums."""
    monkeypatch.setattr(sampling, "BUCKET", 500)
    df = cloud(spark, uneven)
    got = {tuple(ids(sampling.stride_weighted(x, 300, large=large))) for x in (df.coalesce(1), df.repartition(64), df.orderBy(F.desc("mz")))}
    assert len(got) == 1
    order = [i for r in range(43) for i in range(r, len(uneven), 43)]
    total, limit, taken, upto = math.fsum(uneven), 300, 0, []
    first = set()
    for j, i in enumerate(order):
        upto.append(uneven[i])
        if taken < min(limit, math.floor((math.fsum(upto) + 1e-5) * limit / total)):
            taken += 1
            first.add(("a", i))
    assert first <= set(got.pop())


def test_groups_of_several_runs_have_one_order(spark):
    """Ids that begin anew in each run do not leave the order of a group open."""
    df = cloud(spark, range(1, 400), "abcd").withColumn("point_id", F.expr("point_id div 4")).withColumn("one", F.lit(1))
    for strategy in ("WeightedStriding", "UniformStriding", "IntensityCutoff", "UniformSampling", "WeightedReservoir"):
        assert len({tuple(ids(sampling.summarize(df.repartition(k), 40, strategy, ["one"]))) for k in (1, 5, 16)}) == 1


def test_draws(spark):
    df = cloud(spark, [0, 1, 2, 3, 94] * 40, "ab")
    rows = sampling.draw_weighted(df, 20, 3).collect()
    assert {r["run_id"] for r in rows} == {"a", "b"} and len(rows) == 40
    share = sum(r["intensity"] == 94 for r in rows) / 40
    assert 0.75 < share and not any(r["intensity"] == 0 for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sampling.draw_weighted(df.repartition(33), 20, 3).collect()))
    for run in "ab":  # the first n by (pass, id): whole passes, and of the last one the least ids
        own = sorted((r["pass"], r["point_id"]) for r in rows if r["run_id"] == run)
        assert len(set(own)) == 20 and {p for p, _ in own} == set(range(own[-1][0] + 1))


def test_draws_from_one_point_and_from_none(spark):
    one = sampling.draw_weighted(cloud(spark, [0, 5, 0]), 7).collect()
    assert [(r["point_id"], r["pass"]) for r in sorted(one, key=lambda r: r["pass"])] == [(1, p) for p in range(7)]
    with pytest.raises(Exception, match="sum to 0"):
        sampling.draw_weighted(cloud(spark, [0, 0]), 2).collect()
    assert sampling.draw_weighted(cloud(spark, []), 2).count() == 0


def test_draws_by_group_and_by_name(spark):
    df = cloud(spark, range(1, 200)).withColumn("wanted", F.col("meta1") + 1)
    got = sampling.summarize(df, "wanted", "WeightedSampling", ["meta1"]).groupBy("meta1").count().collect()
    assert {r["meta1"]: r["count"] for r in got} == {m: m + 1 for m in range(5)}
    assert set(sampling.STRATEGIES) | set(sampling.REPEATING) == {"IntensityCutoff", "UniformStriding", "WeightedStriding", "UniformSampling", "WeightedReservoir", "WeightedSampling"}
    with pytest.raises(ValueError, match="repeat"):
        pyramid.build_pyramid(df.select(*POINT.names), 20, 2, "WeightedSampling")


def test_reservoirs_merge(spark, tmp_path):
    df = cloud(spark, [i % 13 for i in range(900)], "ab")
    whole = ids(sampling.sample_reservoir(df, 50, 9))
    parts = [sampling.reservoir_state(df.where(f"point_id % 3 = {k}"), 60, 9) for k in range(3)]
    merged = sampling.merged_reservoirs(parts[0].unionByName(parts[1]), 60).unionByName(parts[2])
    assert ids(sampling.merged_reservoirs(merged, 50)) == whole
    df.withColumn("slice", F.col("point_id") % 3).repartition(3, "slice").write.partitionBy("slice").parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    ingest.ingest_stream(spark, f"{tmp_path}/in", POINT, out, f"{tmp_path}/at", reservoir=50, seed=9).awaitTermination()
    assert spark.read.parquet(f"{out}/reservoir").count() <= 3 * 100
    assert ids(ingest.reservoir_so_far(spark, out, 50)) == whole


def test_a_strategy_in_two_steps_never_holds_a_group(spark, tmp_path):
    """A group of 6,000 points for workers that may hold 400."""
    seen = str(tmp_path)

    def strongest(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
        if len(pdf) > 400:
            raise MemoryError(f"{len(pdf)} rows")
        open(f"{seen}/{pdf['point_id'].min()}-{len(pdf)}", "w").close()
        return pdf.sort_values(["intensity", "point_id"], ascending=False).head(n)

    df = cloud(spark, [i * 7919 % 6000 for i in range(6000)])
    df = df.unionByName(cloud(spark, range(5), "b"))
    got = sampling.summarize(df, 60, sampling.TwoStep(strongest, strongest, 300, 5))
    assert ids(got) == ids(sampling.top_intensity(df, 60))
    assert len(list(tmp_path.iterdir())) > 20
