"""Fixed-width point records: 24 bytes, big-endian, mz f8, rt f4, intensity f8, meta1 i4."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfield.functions.scratch import written

RECORD = np.dtype([("mz", ">f8"), ("rt", ">f4"), ("intensity", ">f8"), ("meta1", ">i4")])


#: Bytes that a task reads at a time.
RANGE = RECORD.itemsize * (1 << 18)
POINTS = "point_id long, meta1 int, mz double, rt float, intensity double"


def _frame(data: bytes, ids: np.ndarray) -> pd.DataFrame:
    found = np.frombuffer(data, RECORD)
    return pd.DataFrame({"point_id": ids, "meta1": found["meta1"].astype("i4"), "mz": found["mz"].astype("f8"), "rt": found["rt"].astype("f4"), "intensity": found["intensity"].astype("f8")})


def _ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            files, path = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", row.path))
            with files.open_input_file(path) as source:
                data = source.read_at(int(row.n_bytes), int(row.at))
            first = row.base + row.at // RECORD.itemsize
            yield _frame(data, np.arange(first, first + len(data) // RECORD.itemsize))


def read_point_records(spark: SparkSession, path: str) -> DataFrame:
    """The points of record files; point_id is the record's ordinal, over all files in the order of their paths.

    Tasks read ranges of whole records, so large files are split. A partial record at the end is an error of the file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")  # contents are not read here
    size = RECORD.itemsize
    whole = F.when(F.col("length") % size == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("a partial record at the end of "), "path")).cast("long"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.withColumn("length", whole).withColumn("base", F.coalesce(F.sum(F.expr(f"length div {size}")).over(before), F.lit(0))).where("length > 0")
    ranges = files.withColumn("at", F.explode(F.expr(f"sequence(0L, length - 1, {RANGE}L)"))).withColumn("n_bytes", F.least(F.lit(RANGE), F.col("length") - F.col("at")))
    return ranges.repartition("path", "at").select("path", "at", "n_bytes", "base").mapInPandas(_ranges, POINTS)


def records_of(ranges: DataFrame) -> DataFrame:
    """(uri, start, end), ranges of whole records -> points; run_id is the file, point_id the record's ordinal in it."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                files, path = pa.fs.FileSystem.from_uri(row.uri)
                with files.open_input_file(path) as source:
                    data = source.read_at(int(row.end - row.start), int(row.start))
                if len(data) % RECORD.itemsize:
                    raise ValueError(f"a partial record at the end of {row.uri}")
                first = row.start // RECORD.itemsize
                yield _frame(data, np.arange(first, first + len(data) // RECORD.itemsize)).assign(run_id=row.uri)

    cut = ranges.select("uri", "end", F.explode(F.sequence("start", F.col("end") - 1, F.lit(RANGE).cast("long"))).alias("start"))
    return cut.select("uri", "start", F.least(F.col("start") + RANGE, F.col("end")).alias("end")).repartition("uri", "start").mapInPandas(read, f"{POINTS}, run_id string")


def write_point_records(df: DataFrame, path: str) -> DataFrame:
    """Writes points with ids as record files, range-sorted by point_id, into the folder ``path``, a URI; returns (file, n_points).

    A file is named by its least id and moved to that name when it is complete, so a task that runs again changes nothing.
    """
    fields = [F.col(c) for c in RECORD.names]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = pa.fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        part, name, n = f"{folder}/_{uuid.uuid4().hex}", None, 0
        with files.open_output_stream(part) as out:
            for f in frames:
                if len(f):
                    name = name or f"{f['point_id'].iloc[0]:020d}.bin"
                    data = np.empty(len(f), RECORD)
                    for c in RECORD.names:
                        data[c] = f[c].to_numpy()
                    out.write(data.tobytes())
                    n += len(f)
        if name:
            files.move(part, f"{folder}/{name}")
            yield pd.DataFrame({"file": [name], "n_points": [n]})
        else:
            files.delete_file(part)

    dealt = df.select("point_id", *fields).repartitionByRange("point_id").sortWithinPartitions("point_id")
    return written(dealt.mapInPandas(write, "file string, n_points long"), "records")
