"""Spectra from mzML files, split between tasks, and their peaks as points."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from peakfield.functions.points import file_of

#: Accessions of the controlled vocabulary.
MS_LEVEL, SCAN_START = "MS:1000511", "MS:1000016"
MZ_ARRAY, INTENSITY_ARRAY = "MS:1000514", "MS:1000515"
FLOAT_32, FLOAT_64 = "MS:1000521", "MS:1000523"
ZLIB, RAW = "MS:1000574", "MS:1000576"

SPECTRUM = """
_index long, cvParam array<struct<_accession string, _value string>>,
scanList struct<scan array<struct<cvParam array<struct<_accession string, _value string, _unitName string>>>>>,
binaryDataArrayList struct<binaryDataArray array<struct<cvParam array<struct<_accession string, _value string>>, binary string>>>
"""
POINTS = "run_id string, spectrum_index long, rt float, mz array<double>, intensity array<double>, reason string"


def read_mzml_spectra(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, spectrum_index, ms_level, rt, rt_unit, arrays), a row for each spectrum of each file.

    Files are read as text that ends at </spectrum>, so large ones are split; what precedes the
    opening tag, and the rest after the last spectrum, is left out. run_id is the file's full path, as files in
    different folders may have the same name.
    """
    return parsed(raw_spectra(spark.read, path))


def raw_spectra(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """(value, run_id): the text up to the end of each spectrum, as a table or as a stream."""
    return reader.format("text").option("lineSep", "</spectrum>").load(path).select("value", file_of().alias("run_id"))


def parsed(text: DataFrame) -> DataFrame:
    """raw_spectra -> read_mzml_spectra"""
    body = F.concat(F.regexp_extract("value", r"(?s)(<spectrum\s.*)$", 1), F.lit("</spectrum>"))
    rows = text.where(F.col("value").rlike(r"<spectrum\s")).select("run_id", F.from_xml(body, SPECTRUM).alias("s"))
    of = lambda params, accession: F.filter(params, lambda p: p["_accession"] == accession)[0]
    start = of(F.flatten(F.transform("s.scanList.scan", lambda x: x["cvParam"])), SCAN_START)
    return rows.select(
        "run_id", F.col("s._index").alias("spectrum_index"), of(F.col("s.cvParam"), MS_LEVEL)["_value"].cast("short").alias("ms_level"),
        start["_value"].cast("float").alias("rt"), start["_unitName"].alias("rt_unit"),
        F.transform("s.binaryDataArrayList.binaryDataArray", lambda a: F.struct(F.transform(a["cvParam"], lambda p: p["_accession"]).alias("terms"), a["binary"].alias("binary"))).alias("arrays"),
    )


def _values(terms: list[str], text: str | None) -> np.ndarray:
    if FLOAT_64 in terms:
        kind = "<f8"
    elif FLOAT_32 in terms:
        kind = "<f4"
    else:
        raise ValueError("no bit width")
    if ZLIB not in terms and RAW not in terms and any(t in UNSUPPORTED for t in terms):
        raise ValueError("unsupported compression")
    data = base64.b64decode(text or "")
    return np.frombuffer(zlib.decompress(data) if ZLIB in terms else data, kind).astype("f8")


#: Compression terms that are not read.
UNSUPPORTED = {"MS:1002312", "MS:1002313", "MS:1002314", "MS:1002746", "MS:1002747", "MS:1002748"}


def peaks_of(arrays: list[dict] | None) -> tuple[np.ndarray | None, np.ndarray | None, str | None]:
    """(mz, intensity, None) of a spectrum's encoded arrays, or the reason why they cannot be read."""
    found = {}
    try:
        for a in arrays if arrays is not None else ():
            terms = list(a["terms"])
            for name, accession in (("mz", MZ_ARRAY), ("intensity", INTENSITY_ARRAY)):
                if accession in terms:
                    found[name] = _values(terms, a["binary"])
    except (ValueError, zlib.error) as e:
        return None, None, str(e)
    if len(found) < 2:
        return None, None, "missing array"
    if len(found["mz"]) != len(found["intensity"]):
        return None, None, "arrays of different length"
    return found["mz"], found["intensity"], None


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = [(row.run_id, row.spectrum_index, row.rt, *peaks_of(row.arrays)) for row in frame.itertuples()]
        yield pd.DataFrame(out, columns=["run_id", "spectrum_index", "rt", "mz", "intensity", "reason"])


def decoded(spectra: DataFrame) -> DataFrame:
    """(run_id, spectrum_index, rt, mz, intensity, reason): arrays of numbers, or the reason why there are none."""
    return spectra.select("run_id", "spectrum_index", "rt", "arrays").mapInPandas(_decode, POINTS)


def decode_spectra(spectra: DataFrame) -> DataFrame:
    """(run_id, spectrum_index, position, meta1, mz, rt, intensity), a row for each peak of the spectra that can be read."""
    return points_of(decoded(spectra))


def points_of(found: DataFrame) -> DataFrame:
    """decoded -> decode_spectra"""
    peaks = found.where("reason IS NULL").select("run_id", "spectrum_index", "rt", F.posexplode(F.arrays_zip("mz", "intensity")).alias("position", "peak"))
    return peaks.select("run_id", "spectrum_index", "position", F.lit(0).alias("meta1"), F.col("peak.mz").alias("mz"), "rt", F.col("peak.intensity").alias("intensity"))


def refused(found: DataFrame) -> DataFrame:
    """decoded -> quarantine"""
    return found.where("reason IS NOT NULL").select("run_id", "spectrum_index", "reason")


def quarantine(spectra: DataFrame) -> DataFrame:
    """(run_id, spectrum_index, reason) of the spectra that cannot be read."""
    return refused(decoded(spectra))
