"""Samplers: about n representative points of a run, or of each tile or window.

All return the chosen rows with the columns they came with. ``group`` is what n counts for; with
``large`` groups may be of any size (see ``ordering.index_within``). Rows stand in point_id order
where a sampler walks through them. ``n`` is a number, or the name of a column that says it for each row's group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakfield.functions.points import uniform
from peakfield.functions.scratch import written
from peakfield.functions.sums import exact_sums, limbs, total, unit
from peakfield.operators.ordering import index_within

STRIDE = 43
#: Rows in a bucket of a two-level running sum or minimum.
BUCKET = 1 << 16
#: Rows that a summary looks at in one window's partition; larger groups are dealt over tasks.
WINDOW_ROWS = 1 << 20
#: Slack of the running total against its threshold.
SLACK = 1e-5


def _number(n: int | str) -> Column:
    return F.col(n) if isinstance(n, str) else F.lit(n)


def _ids(df: DataFrame, group: list[str]) -> list[str]:
    """What numbers the points of a group: point_id, after run_id where a group may hold several runs, as ids need not differ between runs."""
    return ["point_id"] if "run_id" in group or "run_id" not in df.columns else ["run_id", "point_id"]


def _first(df: DataFrame, n: int | str, group: list[str], order: list[Column], most: int | None = None) -> DataFrame:
    """The first n of each group in the given order; where n is a number, or has ``most`` as its greatest value, Spark keeps so many rows for each group and task, not all."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    first = F.col("_rank") <= _number(n)
    return df.withColumn("_rank", rank).where(first if most is None else first & (F.col("_rank") <= most)).drop("_rank")


def top_intensity(df: DataFrame, n: int | str, group: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The n most intense; among equal ones the later point wins."""
    group = group or ["run_id"]
    return _first(df, n, group, [F.desc("intensity"), *(F.desc(c) for c in _ids(df, group))], most)


def sample_uniform(df: DataFrame, n: int | str, seed: int = 0, group: list[str] | None = None) -> DataFrame:
    """n points, each with the same chance."""
    group = group or ["run_id"]
    return _first(df, n, group, [uniform(seed, "point_id"), *map(F.col, _ids(df, group))])


def sample_reservoir(df: DataFrame, n: int | str, seed: int = 0, group: list[str] | None = None) -> DataFrame:
    """n points drawn without repeats by weight: the n greatest keys u ** (1 / intensity), compared as ln(u) / intensity.

    Points of intensity 0 or less come last.
    """
    return reservoir_state(df, n, seed, group).drop("key")


def reservoir_state(df: DataFrame, n: int | str, seed: int = 0, group: list[str] | None = None) -> DataFrame:
    """sample_reservoir with the points' keys, which is all that is needed to go on with further points: see ``merged_reservoirs``."""
    return merged_reservoirs(df.withColumn("key", F.when(F.col("intensity") > 0, F.ln(uniform(seed, "point_id")) / F.col("intensity"))), n, group)


def merged_reservoirs(states: DataFrame, n: int | str, group: list[str] | None = None) -> DataFrame:
    """One state from any number of states of the same seed and of n or more points, which together stand for all points that they have seen."""
    group = group or ["run_id"]
    return _first(states, n, group, [F.col("key").desc_nulls_last(), *map(F.col, _ids(states, group))])


def sample_weighted(df: DataFrame, n: int, seed: int = 0, passes: int = 4) -> DataFrame:
    """n draws in passes over each run; a pass keeps a point with probability n * intensity / sum / 2, so points may repeat.

    Passes are doubled until every run has its n draws. Runs without any intensity cannot be drawn
    from, which is an error.
    """
    sums = df.groupBy("run_id").agg(F.sum("intensity").alias("_sum"))
    if not sums.where("NOT _sum > 0").isEmpty():
        raise ValueError("a run's intensities sum to 0")
    rows = df.join(sums, "run_id").withColumn("_half", F.col("intensity") * n / F.col("_sum") / 2)
    while True:
        drawn = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).where(uniform(seed, "pass", "point_id") <= F.col("_half"))
        if drawn.groupBy("run_id").count().where(F.col("count") >= n).count() == sums.count():
            return _first(drawn, n, ["run_id"], [F.col("pass"), F.col("point_id")]).drop("_sum", "_half")
        passes *= 2


def draw_weighted(df: DataFrame, n: int | str, seed: int = 0, group: list[str] | None = None) -> DataFrame:
    """n draws of each group in passes, as ``sample_weighted`` makes them, without going through passes; adds ``pass``. Points may repeat.

    Between the passes that keep a point lie geometric gaps, so each point's passes follow from as many random numbers as it has draws.
    How many passes are needed is known before: so many that the draws expected exceed n by eight standard deviations.
    The first n by (pass, id) are the sample. Groups without any intensity cannot be drawn from, which is an error.
    """
    group = group or ["run_id"]
    wanted = _number(n).cast("double")
    sums = exact_sums(df, group, {"_sum": F.col("intensity")})
    none = F.raise_error(F.lit("a group's intensities sum to 0")).cast("double")
    half = F.col("intensity") * wanted / F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(none) / 2
    rows = df.join(sums, group).withColumn("_p", F.least(F.lit(1.0), half)).where("_p > 0")
    means = rows.groupBy(*group).agg(F.ceil((F.max(wanted) + 8 * F.sqrt(F.max(wanted)) + 20) / F.sum("_p")).alias("_passes"))
    rows = rows.join(means, group)
    # ln(1 - p), and how many gaps a point has at most but for a chance of 1e-30
    rate = F.when(F.col("_p") < 1e-8, -F.col("_p")).otherwise(F.ln(1 - F.col("_p")))
    mean = F.col("_passes") * F.col("_p")
    most = F.least(F.col("_passes"), F.ceil(mean + 12 * F.sqrt(mean) + 40)).cast("int")
    gap = lambda j: F.when(F.col("_p") >= 1, 0).otherwise(F.floor(F.ln(uniform(seed, j, "point_id")) / rate))
    rows = rows.withColumn("_draw", F.lit(0)).withColumn("_gap", gap("_draw")).where("_gap < _passes")  # points with a draw: about as many as there are draws
    rows = rows.withColumn("_draw", F.explode(F.sequence(F.lit(0), most - 1))).withColumn("_gap", gap("_draw"))
    own = Window.partitionBy(*group, *_ids(df, group)).orderBy("_draw")
    rows = rows.withColumn("pass", (F.sum(F.col("_gap") + 1).over(own) - 1).cast("long")).where("pass < _passes")
    return _first(rows, n, group, [F.col("pass"), *map(F.col, _ids(df, group))]).select(*df.columns, "pass")


def stride_uniform(df: DataFrame, n: int | str, group: list[str] | None = None, large: bool = True) -> DataFrame:
    """Every (size div n)-th point, n of them; all if there are no more than n."""
    group = group or ["run_id"]
    rows = index_within(df, group, _ids(df, group), "_idx", large)
    wanted = f"`{n}`" if isinstance(n, str) else str(n)
    step = f"greatest(1, n div {wanted})"
    return rows.where(f"n <= {wanted} OR (_idx % {step} = 0 AND _idx div {step} < {wanted})").drop("_idx", "n")


def _visit(idx: str, size: str, stride: int) -> Column:
    """When a walk in strides, then from the next start, and so on, comes to row ``idx`` of ``size``: 0, 1, 2, ..."""
    return F.expr(f"({idx} % {stride}) * ({size} div {stride}) + least({idx} % {stride}, {size} % {stride}) + {idx} div {stride}")


def stride_weighted(df: DataFrame, n: int | str, group: list[str] | None = None, stride: int = STRIDE, weight: str = "intensity", large: bool = True) -> DataFrame:
    """A walk in strides that takes a point whenever the weights since the last one reach sum / n.

    The walk in closed form: with S_j the running sum and F_j = floor(S_j * n / sum), the points taken
    among the first j are c_j = j + min(0, min over i <= j of (F_i - i)). If a late spike leaves too
    few, the skipped points are walked again the same way, and as the total is by then large enough
    for each, the first ones are taken.

    Large groups are summed in two levels: windows cover a bucket of rows, and what earlier buckets hold comes
    from tables with a row for each bucket. Weights are summed as whole numbers (``functions.sums``), so that the points taken do not hang
    on the order in which rows meet.
    """
    group = group or ["run_id"]
    rows = index_within(df, group, _ids(df, group), "_idx", large).withColumn("_j", _visit("_idx", "n", stride))
    wanted, at = _number(n), F.col("_j") + 1
    reached = F.when(F.col("_sum") > 0, F.least(wanted, F.floor((F.col("_s") + SLACK) * wanted / F.col("_sum")))).otherwise(F.least(wanted, at))
    bucket = [*group, "_bucket"] if large else group
    whole, inside = Window.partitionBy(*group), Window.partitionBy(*bucket).orderBy("_j")
    upto, before = (inside.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    high, low = limbs(F.col(weight).cast("double"), F.col("_unit"))
    add = lambda h, l: total(h, l, F.col("_unit"))  # noqa: E731, E741
    if large:
        earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        units = df.groupBy(*group).agg(unit(F.max(F.abs(F.col(weight).cast("double")))).alias("_unit"))
        rows = rows.withColumn("_bucket", F.expr(f"_j div {BUCKET}")).join(units, group).withColumn("_high", high).withColumn("_low", low)
        sums = rows.groupBy(*bucket, "_unit").agg(F.sum("_high").alias("_h"), F.sum("_low").alias("_l"))
        before_this = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_base{c}") for c in ("_h", "_l")]
        sums = sums.select(*bucket, add(F.sum("_h").over(whole), F.sum("_l").over(whole)).alias("_sum"), *before_this)
        rows = rows.join(sums, bucket).withColumn("_s", add(F.col("_base_h") + F.sum("_high").over(upto), F.col("_base_l") + F.sum("_low").over(upto)))
    else:
        rows = rows.withColumn("_unit", unit(F.max(F.abs(F.col(weight).cast("double"))).over(whole))).withColumn("_high", high).withColumn("_low", low)
        rows = rows.withColumn("_sum", add(F.sum("_high").over(whole), F.sum("_low").over(whole))).withColumn("_s", add(F.sum("_high").over(upto), F.sum("_low").over(upto)))
    rows = rows.withColumn("_behind", reached - at).withColumn("_upto", F.min("_behind").over(upto)).withColumn("_before", F.min("_behind").over(before))
    if large:
        rows = written(rows, "walk")
        least = rows.groupBy(*bucket).agg(F.min("_behind").alias("_least")).select(*bucket, F.min("_least").over(earlier).alias("_earlier"), F.min("_least").over(whole).alias("_last"))
        rows = rows.join(least, bucket)
    else:
        rows = rows.withColumn("_earlier", F.lit(None).cast("long")).withColumn("_last", F.min("_behind").over(whole))
    taken = F.col("n") + F.least(F.lit(0), F.col("_last"))
    upto_this = at + F.least(F.lit(0), F.col("_upto"), F.col("_earlier"))
    hit = upto_this > F.col("_j") + F.least(F.lit(0), F.col("_before"), F.col("_earlier"))
    rows = rows.withColumn("_skip", F.col("_j") - upto_this).withColumn("_skips", F.col("n") - taken)
    again = ~hit & (_visit("_skip", "_skips", stride) < wanted - taken)
    return rows.where((F.col("n") <= wanted) | hit | again).select(*df.columns)


@dataclass(frozen=True)
class TwoStep:
    """A user's strategy for groups of any size: ``partial`` (pandas frame, n) makes few rows of a part of a group, ``merge`` makes one such result of several.

    Parts have about ``rows`` rows, and up to ``fan_in`` results meet at a time, so no frame grows with its group.
    Merging has to give the same in any grouping. Frames have the columns of the points; rows come in no order.
    """

    partial: Callable[[pd.DataFrame, int], pd.DataFrame]
    merge: Callable[[pd.DataFrame, int], pd.DataFrame]
    rows: int = 100_000
    fan_in: int = 16


def in_parts(df: DataFrame, n: int | str, strategy: TwoStep, group: list[str]) -> DataFrame:
    """Parts are dealt by a hash of the ids, then merged in rounds, as many as the largest group needs."""
    sizes = written(df.groupBy(*group).agg(F.count("*").alias("_size")).withColumn("_parts", F.expr(f"(_size + {strategy.rows - 1}) div {strategy.rows}")), "sizes")
    parts = sizes.agg(F.max("_parts")).first()[0] or 1
    said = lambda pdf: int(pdf[n].iloc[0]) if isinstance(n, str) else n

    def applied(rows: DataFrame, function: Callable) -> DataFrame:
        columns = df.columns

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            return function(pdf[columns], said(pdf)).assign(_part=pdf["_part"].iloc[0])[[*columns, "_part"]]

        return rows.groupBy(*group, "_part").applyInPandas(one, rows.select(*columns, "_part").schema)

    part = F.pmod(F.xxhash64(*_ids(df, group)), F.col("_parts")).cast("long")
    rows = applied(df.join(sizes, group).withColumn("_part", part).select(*df.columns, "_part"), strategy.partial)
    while parts > 1:
        parts = -(-parts // strategy.fan_in)
        rows = applied(written(rows, "parts").withColumn("_part", F.expr(f"_part div {strategy.fan_in}L")), strategy.merge)
    return rows.select(*df.columns)


STRATEGIES: dict[str, Callable] = {
    "IntensityCutoff": top_intensity,
    "UniformStriding": stride_uniform,
    "WeightedStriding": stride_weighted,
    "UniformSampling": sample_uniform,
    "WeightedReservoir": sample_reservoir,
}
#: Strategies that may return a point more than once, which a tree cannot show.
REPEATING: dict[str, Callable] = {
    "WeightedSampling": lambda df, n, seed=0, group=None: draw_weighted(df, n, seed, group).drop("pass"),
}


def summarize(df: DataFrame, n: int | str, strategy: str | Callable | TwoStep = "WeightedStriding", group: list[str] | None = None, **settings) -> DataFrame:
    """n points of each group by a named strategy, by a TwoStep of a user's own, or by a function of (pandas frame of a whole group, n), for groups with a bound."""
    group = group or ["run_id"]
    if isinstance(strategy, TwoStep):
        return in_parts(df, n, strategy, group)
    if callable(strategy):
        return df.groupBy(*group).applyInPandas(lambda pdf: strategy(pdf, int(pdf[n].iloc[0]) if isinstance(n, str) else n), df.schema)
    known = STRATEGIES | REPEATING
    if strategy not in known:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(known)}")
    return known[strategy](df, n, group=group, **settings)


def summarize_sized(df: DataFrame, n: str, strategy: str | Callable | TwoStep, group: list[str], sizes: DataFrame) -> DataFrame:
    """``summarize``, told by ``sizes`` (group, n's column, rows) how many rows each group has at most; ``df`` is not looked at for it.

    Strides walk a group in one window's partition if it has ``WINDOW_ROWS`` at most, which is one exchange of the rows; only larger ones need
    a range sort and tables of buckets.
    """
    if strategy == "IntensityCutoff":
        return summarize(df, n, strategy, group, most=sizes.agg(F.max(n)).first()[0] or 0)
    if not isinstance(strategy, str) or "Striding" not in strategy:
        return summarize(df, n, strategy, group)
    large = written(sizes.where(F.col("rows") > WINDOW_ROWS).select(*group), "large")
    if large.isEmpty():
        return summarize(df, n, strategy, group, large=False)
    df = written(df, "sized")
    small = summarize(df.join(large, group, "left_anti"), n, strategy, group, large=False)
    return small.unionByName(summarize(df.join(large, group, "left_semi"), n, strategy, group))
