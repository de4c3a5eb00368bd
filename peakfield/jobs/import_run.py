"""Import of raw files: parse, filter, decode, number, tile, summarize, persist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakfield.functions.points import POINT
from peakfield.functions.scratch import written
from peakfield.operators.boxes import filter_min_intensity, filter_ms_level
from peakfield.operators.ordering import assign_point_ids
from peakfield.operators.pyramid import levels
from peakfield.operators.tiling import CAPACITY, HEIGHT, largest_run, tile, tree_config
from peakfield.operators.walk import aggregate_tree
from peakfield.sources.mzml import decoded, points_of, read_mzml_spectra, refused
from peakfield.sources.store import write_store


def numbered(found: DataFrame, least: float = 1.0) -> DataFrame:
    """The points of decoded spectra, with ids in the order (run, spectrum, peak)."""
    points = filter_min_intensity(points_of(found), least)
    return assign_point_ids(points, ["run_id", "spectrum_index", "position"]).select(*POINT.names)


def import_run(spark: SparkSession, path: str, out: str, capacity: int = CAPACITY, height: int = HEIGHT, strategy: str = "WeightedStriding") -> None:
    """Builds a store at ``out`` from the mzML files at ``path``; spectra that cannot be read are listed in ``out``/quarantine.

    Spectra are parsed and decoded once, into a scratch table that both results come from.
    """
    found = written(decoded(filter_ms_level(read_mzml_spectra(spark, path))), "decoded")
    refused(found).write.parquet(f"{out}/quarantine")
    points = written(numbered(found), "points")
    _, fan_out = tree_config(largest_run(points), capacity, height)
    pyramid = levels(tile(points, fan_out, capacity, height), fan_out, capacity, height, strategy)
    write_store(pyramid, aggregate_tree(pyramid, fan_out), out)
