"""The point: its schema, its adapters to other tables, and small helpers on its columns.

A point is (run_id, point_id, meta1, mz, rt, intensity). rt is a 32-bit float, as in the files that
instruments write, so literals compared with it are cast to float first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("point_id", T.LongType()), T.StructField("meta1", T.IntegerType()),
    T.StructField("mz", T.DoubleType()), T.StructField("rt", T.FloatType()), T.StructField("intensity", T.DoubleType()),
])
AXES = ("mz", "rt", "intensity")
#: Two points are the same value if these agree; the id does not count.
VALUE = ["meta1", "mz", "rt", "intensity"]


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as one run: value, whole seconds since 2024, and k + 1 as the three axes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    k = F.get_json_object("props", "$.k").cast("long") + 1
    return events.select(F.lit("events").alias("run_id"), F.col("event_id").alias("point_id"), F.col("user_id").cast("int").alias("meta1"), F.col("value").alias("mz"), seconds.cast("float").alias("rt"), k.cast("double").alias("intensity"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem table as points without ids: price, days since 1995 and quantity, a run for each return flag."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return items.select(
        F.col("l_returnflag").alias("run_id"), F.col("l_linenumber").alias("meta1"), F.col("l_extendedprice").alias("mz"), days.cast("float").alias("rt"), F.col("l_quantity").alias("intensity"),
        "l_orderkey", "l_partkey", "l_suppkey",
    )


def project_axes(df: DataFrame, extras: bool = True) -> DataFrame:
    """The axes, with point_id and meta1 before them if ``extras``."""
    return df.select(*(["point_id", "meta1"] if extras else []), *AXES)


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) that depends on the seed and the keys alone: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def file_of(path: str = "_metadata.file_path") -> Column:
    """A file's path in one form, whoever has listed it."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def round_outward(lower: Column, upper: Column, digits: int = 3) -> tuple[Column, Column]:
    """Bounds rounded so that the interval only grows: the lower one down, the upper one up."""
    scale = float(10**digits)
    return F.floor(lower.cast("double") * scale) / scale, F.ceil(upper.cast("double") * scale) / scale
