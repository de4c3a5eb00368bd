"""Incremental import: new files, or ranges of large files, arrive as micro-batches, each is kept under its batch id and may be repeated.

Files of any size are cut into ranges of bytes, each described by a small file of its own; a stream of these has the byte positions as its
offsets, so a batch is bounded, and one that is run again reads the same bytes.

Every batch is tiled with the same fan-out, so that its tree can become a part of a larger one: ``joined_tree``
puts the trees of all batches below common roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakfield.functions.points import POINT
from peakfield.operators.boxes import filter_min_intensity, filter_ms_level
from peakfield.operators.bounds import dataset_summary
from peakfield.operators.ordering import index_within
from peakfield.operators.pyramid import levels, risen
from peakfield.operators.sampling import merged_reservoirs, reservoir_state, summarize
from peakfield.operators.tiling import height_for, largest_run, tile
from peakfield.functions.scratch import written
from peakfield.sources import mzml, ranges, records, text

FAN_OUT = 8


def _arriving(spark: SparkSession, source: str, schema: T.StructType | None, kind: str, files_per_batch: int, positions: str | None) -> DataFrame:
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if positions:
        if kind not in ("mzml", "records"):
            raise ValueError(f"files of kind {kind!r} are not cut")
        return reader.schema(ranges.RANGES).json(positions)
    if kind == "mzml":
        return mzml.raw_spectra(reader, source)
    if kind == "csv":
        return text.raw_lines(reader, source)
    if kind == "parquet":
        return reader.schema(schema or POINT).parquet(source).select(*(schema or POINT).names)
    raise ValueError(f"no kind {kind!r}")


def _points(batch: DataFrame, kind: str, least: float, cut: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The points of a batch and what of it cannot be read; ids count from 0 within what the batch has of each file. Spectra are decoded once."""
    if kind == "parquet":
        return batch, None
    if kind == "csv":
        rows = index_within(text.parsed(batch, "drop"), ["run_id"], ["rt", "mz", "intensity", "meta1"], "point_id")
        return rows.select(*POINT.names), text.refused(batch)
    if kind == "records":
        return records.records_of(batch).select(*POINT.names), None
    found = written(ranges.spectra_of(batch, 1) if cut else mzml.decoded(filter_ms_level(mzml.parsed(batch))), "decoded")
    peaks = filter_min_intensity(mzml.points_of(found), least)
    return index_within(peaks, ["run_id"], ["spectrum_index", "position"], "point_id").select(*POINT.names), mzml.refused(found)


def _after(points: DataFrame, out: str, batch_id: int) -> DataFrame:
    """Ids that go on where the batches before this one, which are complete, have stopped in each file."""
    if not batch_id:
        return points
    bounds = points.sparkSession.read.parquet(f"{out}/bounds").where(F.col("batch") < batch_id)
    before = bounds.groupBy("run_id").agg(F.sum("point_count").alias("_before"))
    return points.join(before, "run_id", "left").withColumn("point_id", F.col("point_id") + F.coalesce("_before", F.lit(0))).select(*POINT.names)


def ingest_stream(
    spark: SparkSession, source: str, schema: T.StructType | None, out: str, checkpoint: str, files_per_batch: int = 1, capacity: int | None = None,
    kind: str = "parquet", fan_out: int = FAN_OUT, strategy: str = "WeightedStriding", least: float = 1.0, bytes_per_batch: int | None = None, reservoir: int | None = None, seed: int = 0, height: int | None = None,
):
    """Starts a query that appends each batch's points and bounds to ``out`` and stops when the source is read.

    kind: "parquet" (points), "csv", "mzml" or "records" files. With ``bytes_per_batch``, mzml and records files are cut, and a batch is ``files_per_batch``
    ranges of so many bytes, however large the files are; files that have come since are added by calling this again. A batch overwrites its own folders, so a batch that is run again after a failure
    changes nothing. With ``capacity`` each batch is also built into a pyramid of its own, of ``height`` levels below its roots at most if that is given (leaves then hold what is left),
    with ``reservoir`` it leaves a sample of so many points by weight, with their keys, under ``out``/reservoir. What cannot be read is kept
    under ``out``/quarantine.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        points, bad = _points(batch, kind, least, bool(positions))
        if positions and kind == "mzml":
            points = _after(points, out, batch_id)
        if capacity:
            tall, leaf = height_for(largest_run(points), capacity, fan_out, height)
            points = levels(tile(points, fan_out, capacity, tall), fan_out, capacity, tall, strategy, leaf)
        points.write.mode("overwrite").parquet(f"{out}/points/batch={batch_id}")
        kept = batch.sparkSession.read.parquet(f"{out}/points/batch={batch_id}")
        dataset_summary(kept).write.mode("overwrite").parquet(f"{out}/bounds/batch={batch_id}")
        if reservoir:
            reservoir_state(kept.select(*POINT.names), reservoir, seed).write.mode("overwrite").parquet(f"{out}/reservoir/batch={batch_id}")
        if bad is not None:
            bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")

    positions = f"{out}/positions" if bytes_per_batch or kind == "records" else None
    if positions:
        record = records.RECORD.itemsize
        size = bytes_per_batch or ranges.RANGE
        ranges.split_files(spark, source, positions, size if kind == "mzml" else max(1, size // record) * record)
    return _arriving(spark, source, schema, kind, files_per_batch, positions).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_summary(spark: SparkSession, out: str) -> DataFrame:
    """dataset_summary of all batches so far, from their bounds alone."""
    bounds = spark.read.parquet(f"{out}/bounds")
    ends = [(F.min if e == "min" else F.max)(f"{a}_{e}").alias(f"{a}_{e}") for a in ("mz", "rt", "int") for e in ("min", "max")]
    return bounds.groupBy("run_id").agg(*ends, F.sum("point_count").alias("point_count"))


def reservoir_so_far(spark: SparkSession, out: str, n: int) -> DataFrame:
    """``sample_reservoir`` over all points of all batches, n being no more than each batch has kept; no points are read but those of the batches' samples."""
    return merged_reservoirs(spark.read.parquet(f"{out}/reservoir").drop("batch"), n).drop("key")


def root_summary(spark: SparkSession, out: str, n: int) -> DataFrame:
    """The n points that stand for all batches: chosen from what each batch's root shows."""
    return summarize(spark.read.parquet(f"{out}/points").where("lod = 0"), n, "IntensityCutoff")


def joined_tree(spark: SparkSession, out: str, capacity: int, fan_out: int = FAN_OUT, strategy: str = "WeightedStriding") -> DataFrame:
    """One pyramid over all batches, as ``build_pyramid`` gives: the batches' roots are the tiles at the depth of the least tree that holds them.

    A batch's number becomes the leading digits of its tile ids, in base ``fan_out``. What the roots show is summarized
    upwards; no batch is tiled or summarized again.
    """
    points = spark.read.parquet(f"{out}/points")
    batches = (spark.read.parquet(f"{out}/bounds").agg(F.max("batch")).first()[0] or 0) + 1
    top = 0
    while fan_out**top < batches:
        top += 1
    ids = F.expr(f"batch * cast(power({fan_out}, leaf_depth) as bigint) + tile_id")
    rows = points.withColumn("tile_id", ids).withColumn("leaf_depth", F.col("leaf_depth") + top).withColumn("lod", F.col("lod") + top).drop("batch")
    return risen(rows, fan_out, capacity, top, strategy)
