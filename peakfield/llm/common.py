"""What the operators of this package share: inputs, scratch tables, ranks and prefix sums.

Every operator takes a DataFrame that has at least ``doc_id`` and ``text`` and reads only the columns
it names, so further columns, whatever they are called, never clash with its own. Rows whose
``doc_id`` is null name no document and are left out; a null text counts as an empty one.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfield.functions.scratch import scratch_path, written  # noqa: F401  (the operators take them from here)

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (never null) and the columns of ``more``, of the rows that have a doc_id."""
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")]
    return docs.where(F.col("doc_id").isNotNull()).select(*kept, *more)


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each doc_id; of rows that share one, the greatest in (text, other columns) stays.

    Ids are nearly always unique already, which reading the id column alone shows; only if they are
    not are the rows shuffled.
    """
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    others = sorted(c for c in docs.columns if c not in ("doc_id", "text"))
    order = F.struct("text", *(F.col(f"`{c}`").cast("string") for c in others))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max_by(row, order).alias("_row")).select("_row.*")


def apart(docs: DataFrame) -> DataFrame:
    """The rows that have a doc_id, each as one struct ``_row``, so that joins meet no name of theirs."""
    return docs.where("doc_id IS NOT NULL").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def crc_of_id() -> Column:
    """CRC-32 of the doc_id written as decimal text; it deals documents into folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a bounded number of bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)


def drop_written(df: DataFrame) -> None:
    """Removes a scratch table that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect garbage, upon which Spark deletes the shuffle files of steps that no table in use goes back to.

    By itself it does so every half hour, by when a job of many steps has filled the executors' disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def hashed_buckets(n_rows: int, per_bucket: int = 20_000) -> int:
    """How many hash buckets hold about ``per_bucket`` of ``n_rows`` rows each."""
    return max(1, -(-n_rows // per_bucket))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows: (doc_id, keys, ...), groups: a written table of (keys, n, ...) -> rows with the columns of their group, or nulls.

    Groups of over a thousandth of all rows that have one, of which there are fewer than a thousand, are broadcast, and
    their rows get keys of their own, so that no task meets a whole hot group.
    """
    more = [c for c in groups.columns if c not in keys]
    hot = F.col(n) * 1000 > groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    large = groups.where(hot).select(*keys, F.struct(*more).alias("_large"))
    small = groups.where(~hot).select(*keys, F.lit(0).cast("long").alias("_own"), F.struct(*more).alias("_small"))
    joined = rows.join(F.broadcast(large), keys, "left").withColumn("_own", F.when(F.col("_large").isNull(), F.lit(0)).otherwise(F.xxhash64("doc_id")))
    joined = joined.join(small, [*keys, "_own"], "left").withColumn("_group", F.coalesce("_large", "_small"))
    return joined.select(*rows.columns, *(F.col("_group")[c].alias(c) for c in more))


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same ``keys`` that come before, in (bucket, order).

    A window over ``keys`` alone would put a hot key into one task. Here windows run over
    (keys, bucket), and what earlier buckets hold is added from a table of one row per key and bucket.
    """
    df = df.withColumn("_value", value.cast("long"))
    sums = df.groupBy(*keys, bucket).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = F.col("_bucket") == F.col(bucket)
    for k in keys:
        same &= F.col(f"_{k}").eqNullSafe(F.col(k))
    return df.join(sums, same).withColumn(out, F.col("_base") + F.col("_inside")).drop("_value", "_inside", "_base", "_bucket", *(f"_{k}" for k in keys))
