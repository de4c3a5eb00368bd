"""Points as CSV and JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from peakfield.functions.points import file_of
from peakfield.operators.boxes import Box, in_box

FIELDS = {"mz": "double", "rt": "float", "intensity": "double", "meta1": "int"}


def raw_lines(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """The four fields as text, and run_id, the file's full path, without header lines, as a table or as a stream.

    A line is a header if its first field is no number and reads m/z or mz.
    """
    schema = ", ".join(f"{c} string" for c in FIELDS) + ", _bad string"
    rows = reader.schema(schema).format("csv").option("columnNameOfCorruptRecord", "_bad").load(path)
    head = F.expr("try_cast(mz AS double)").isNull() & F.lower(F.trim("mz")).isin("m/z", "mz")
    return rows.where(~F.coalesce(head, F.lit(False))).select(*FIELDS, file_of().alias("run_id"))


def _casts() -> list:
    return [F.expr(f"try_cast(trim({c}) AS {kind})") for c, kind in FIELDS.items()]


def read_points_csv(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    """(mz, rt, intensity, meta1, run_id) by position. bad: "raise" on a field that is no number, or "drop" such lines."""
    return parsed(raw_lines(spark.read, path), bad)


def parsed(rows: DataFrame, bad: str = "raise") -> DataFrame:
    """raw_lines -> read_points_csv"""
    if bad == "drop":
        rows = rows.where(" AND ".join(f"try_cast(trim({c}) AS {kind}) IS NOT NULL" for c, kind in FIELDS.items()))
        return rows.select(*(x.alias(c) for x, c in zip(_casts(), FIELDS, strict=True)), "run_id")
    told = lambda c: F.raise_error(F.concat(F.lit(f"{c} is no number: "), F.coalesce(c, F.lit("nothing"))))
    return rows.select(*(F.coalesce(x, told(c).cast(FIELDS[c])).alias(c) for x, c in zip(_casts(), FIELDS, strict=True)), "run_id")


def refused(rows: DataFrame) -> DataFrame:
    """The raw_lines that cannot be read, with the first field that is wrong."""
    reason = F.coalesce(*(F.when(x.isNull(), F.lit(c)) for x, c in zip(_casts(), FIELDS, strict=True)))
    return rows.withColumn("reason", reason).where("reason IS NOT NULL")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``read_points_csv`` would refuse, with the first field that is wrong."""
    return refused(raw_lines(spark.read, path))


def export_csv(df: DataFrame, path: str, box: Box) -> int:
    """Writes the points inside ``box``, all fields quoted under a header; returns their number, counted in the same pass."""
    seen = Observation()
    rows = in_box(df, box).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.select(F.col("mz").alias("m/z"), F.col("rt").alias("RT"), "intensity", "meta1").write.option("header", True).option("quoteAll", True).csv(path)
    return seen.get["n"]


def to_json_rows(df: DataFrame, extras: bool = True, limit: int | None = None) -> DataFrame:
    """(value): each point as a JSON array, [id, meta1, mz, rt, intensity] or [mz, rt, intensity]."""
    rows = df.orderBy("point_id").limit(limit) if limit else df
    names = (["point_id", "meta1"] if extras else []) + ["mz", "rt", "intensity"]
    return rows.select(F.concat(F.lit("["), F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names)), F.lit("]")).alias("value"))
