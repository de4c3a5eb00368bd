"""A store: the pyramid's points and its tiles as Parquet, laid out by level and along a curve.

``lod`` is the partition column, so a query that shows depth d opens the folders of the levels up to d and no others. Within a level
files are range-sorted by run and by a Z-order curve over (rt, mz): what lies close together in a run shares row groups, whose
statistics of run_id, mz and rt skip the rest. Runs are a column, not folders, as there may be many and their names may be long paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfield.sources.mzml import decode_spectra, read_mzml_spectra
from peakfield.sources.text import read_points_csv


#: Bits of an axis in the curve.
BITS = 16


def _spread(x: Column) -> Column:
    """The bits of a 16-bit number, each with a gap behind it."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def curve(rt: tuple[Column, Column, Column], mz: tuple[Column, Column, Column]) -> Column:
    """The place of a point on the Z-order curve. rt, mz: (value, least, greatest)."""

    def grid(value: Column, low: Column, high: Column) -> Column:
        low, high = low.cast("double"), high.cast("double")
        return F.when(high > low, F.floor((value.cast("double") - low) / (high - low) * ((1 << BITS) - 1))).otherwise(0).cast("long")

    return F.shiftleft(_spread(grid(*rt)), 1).bitwiseOR(_spread(grid(*mz)))


def write_store(points: DataFrame, tiles: DataFrame, path: str) -> None:
    """points: a pyramid, with lod. tiles: its tiles table; the roots have the bounds of the runs."""
    roots = tiles.where("depth = 0").select("run_id", *(F.col(f"{a}_{e}").alias(f"_{a}_{e}") for a in ("mz", "rt") for e in ("min", "max")))
    z = curve(*((F.col(a), F.col(f"_{a}_min"), F.col(f"_{a}_max")) for a in ("rt", "mz")))
    placed = points.join(roots, "run_id").withColumn("_z", z)
    order = ["lod", "run_id", "_z"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*points.columns).write.partitionBy("lod").parquet(f"{path}/points")
    tiles.write.parquet(f"{path}/tiles")


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    points = spark.read.option("recursiveFileLookup", False).parquet(f"{path}/points")
    return points.withColumn("lod", F.col("lod").cast("int")), spark.read.parquet(f"{path}/tiles")


def copy_store(spark: SparkSession, source: str, target: str) -> None:
    """Refuses a target that exists."""
    for part, by in (("points", ["lod"]), ("tiles", [])):
        spark.read.parquet(f"{source}/{part}").write.partitionBy(*by).mode("errorifexists").parquet(f"{target}/{part}")


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Points from CSV, mzML or a store; ``kind`` wins over the suffix."""
    lower = path.lower().rstrip("/")
    kind = kind or ("csv" if lower.endswith(".csv") else "mzml" if lower.endswith((".mzml", ".xml")) else "store")
    if kind == "csv":
        return read_points_csv(spark, path)
    if kind == "mzml":
        return decode_spectra(read_mzml_spectra(spark, path))
    if kind == "store":
        return open_store(spark, path)[0]
    raise ValueError(f"no kind {kind!r}")
