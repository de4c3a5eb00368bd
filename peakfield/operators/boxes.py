"""Filters on spectra and points, and windows (boxes) in the plane of mz and rt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Closed on all sides; None or 0 leaves a side open."""

    mz_min: float | None = None
    mz_max: float | None = None
    rt_min: float | None = None
    rt_max: float | None = None

    def bounds(self) -> list[tuple[str, str, float]]:
        """(axis, min or max, value) of the sides that are not open."""
        return [(axis, end, v) for axis in ("mz", "rt") for end in ("min", "max") if (v := getattr(self, f"{axis}_{end}"))]


def open_box(*fields: str | float | None) -> Box:
    """A box from form fields mz_min, mz_max, rt_min, rt_max; a blank field leaves its side open."""
    values = [None if f is None or (isinstance(f, str) and not f.strip()) else float(f) for f in fields]
    return Box(*values)


def _side(axis: str, value: float) -> Column:
    return F.lit(value).cast("float" if axis == "rt" else "double")


def in_box(df: DataFrame, box: Box) -> DataFrame:
    """The points inside ``box``; each side is a plain comparison that the scan can push down."""
    for axis, end, value in box.bounds():
        df = df.where(F.col(axis) >= _side(axis, value) if end == "min" else F.col(axis) <= _side(axis, value))
    return df


def tiles_overlapping(tiles: DataFrame, box: Box) -> DataFrame:
    """The tiles whose bounds meet ``box``, edges included."""
    for axis, end, value in box.bounds():
        tiles = tiles.where(F.col(f"{axis}_max") >= _side(axis, value) if end == "min" else F.col(f"{axis}_min") <= _side(axis, value))
    return tiles


def validated(boxes: DataFrame) -> DataFrame:
    """A table of boxes with ``reason``: null if valid. Raw values count, so (500, 0) is inverted too."""
    sides = ["mz_min", "mz_max", "rt_min", "rt_max", "num_points"]
    missing = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in sides))
    reason = F.when(missing != "", F.concat(F.lit("missing "), missing)).when(F.col("mz_max") < F.col("mz_min"), "mz inverted").when(F.col("rt_max") < F.col("rt_min"), "rt inverted").when(F.col("num_points") < 0, "negative count")
    return boxes.withColumn("reason", reason)


def filter_min_intensity(df: DataFrame, least: float = 1.0) -> DataFrame:
    return df.where(F.col("intensity") >= F.lit(least))


def filter_ms_level(spectra: DataFrame, level: int = 1) -> DataFrame:
    """Spectra of ``level``; those that do not state a level are kept as well."""
    return spectra.where(F.col("ms_level").isNull() | F.col("ms_level").isin(0, level))
