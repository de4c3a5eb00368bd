"""Ranges of bytes of files: the unit that tasks and batches read, however large a file is.

A range of an mzML file stands for the spectra whose opening tag begins in it, so ranges that cover a file hold every spectrum once,
wherever they cut it.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from peakfield.functions.points import file_of
from peakfield.sources.mzml import MS_LEVEL, SCAN_START, peaks_of

OPEN, CLOSE = re.compile(rb"<spectrum\s"), b"</spectrum>"
#: Bytes of a file that are asked for at a time, and the size of a range by default.
CHUNK, RANGE = 1 << 20, 32 << 20
SPECTRA = "run_id string, spectrum_index long, ms_level short, rt float, rt_unit string, mz array<double>, intensity array<double>, reason string"
KINDS = {"run_id": pa.string(), "spectrum_index": pa.int64(), "ms_level": pa.int16(), "rt": pa.float32(), "rt_unit": pa.string(), "mz": pa.list_(pa.float64()), "intensity": pa.list_(pa.float64()), "reason": pa.string()}
#: Peaks that a batch of decoded spectra holds, give or take a spectrum.
PEAKS = 1 << 18
RANGES = "uri string, start long, end long"


def uri_of(path: str) -> str:
    """A file's path as a URI, in the form that ``file_of`` gives."""
    return re.sub("^file:/+", "file:///", path if "://" in path or path.startswith("file:") else f"file://{path}")


def opened(uri: str) -> pa.NativeFile:
    files, path = pa.fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files at or below ``path``, sorted; hidden ones are left out."""
    uri = uri_of(path)
    files, below = pa.fs.FileSystem.from_uri(uri)
    head = uri[: len(uri) - len(below)]
    info = files.get_file_info(below)
    found = [info] if info.is_file else files.get_file_info(pa.fs.FileSelector(below, recursive=True))
    return sorted((head + f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "_.")


def elements(source: pa.NativeFile, start: int, end: int, chunk: int = CHUNK) -> Iterator[bytes]:
    """The spectra, from <spectrum to </spectrum>, whose opening tag begins in [start, end); a last one that never closes is left out."""
    held, base, size = b"", start, source.size()

    def more() -> bool:
        nonlocal held
        data = source.read_at(min(chunk, size - base - len(held)), base + len(held)) if base + len(held) < size else b""
        held += data
        return bool(data)

    while True:
        tag = OPEN.search(held)
        if not tag:
            keep = min(len(held), 9)  # a tag may be cut between two chunks
            base, held = base + len(held) - keep, held[len(held) - keep :]
            if base >= end or not more():
                return
            continue
        at = tag.start()
        if base + at >= end:
            return
        seen, stop = at, held.find(CLOSE, at)
        while stop < 0:
            seen = max(at, len(held) - len(CLOSE))
            if not more():
                return
            stop = held.find(CLOSE, seen)
        stop += len(CLOSE)
        yield held[at:stop]
        base, held = base + stop, held[stop:]


_PARAM = re.compile(rb"<cvParam\s[^>]*>")
_ATTRIBUTE = re.compile(rb"([\w:]+)\s*=\s*[\"']([^\"']*)[\"']")


def header(element: bytes) -> dict:
    """spectrum_index, ms_level, rt and rt_unit, from the text before the arrays; neither XML nor base64 is parsed."""
    head = element[: at if (at := element.find(b"<binaryDataArrayList")) >= 0 else len(element)]
    own = dict(_ATTRIBUTE.findall(head[: head.find(b">")]))
    found = {"spectrum_index": int(own[b"index"]) if own.get(b"index", b"").isdigit() else None, "ms_level": None, "rt": None, "rt_unit": None}
    for tag in _PARAM.findall(head):
        param = dict(_ATTRIBUTE.findall(tag))
        name, value = param.get(b"accession", b"").decode(), param.get(b"value", b"").decode()
        if name == MS_LEVEL and found["ms_level"] is None and value.isdigit():
            found["ms_level"] = int(value)
        elif name == SCAN_START and found["rt"] is None:
            try:
                found["rt"] = float(np.float32(value))
            except ValueError:
                continue
            found["rt_unit"] = param[b"unitName"].decode() if b"unitName" in param else None
    return found


def arrays(element: bytes) -> tuple[np.ndarray | None, np.ndarray | None, str | None]:
    """(mz, intensity, None), or the reason why they cannot be read."""
    try:
        tree = ET.fromstring(element)
    except ET.ParseError as e:
        return None, None, f"no XML: {e}"
    return peaks_of([{"terms": [p.get("accession") for p in a.iter("cvParam")], "binary": a.findtext("binary")} for a in tree.iter("binaryDataArray")])


def spectra(uri: str, start: int, end: int, wanted: Callable[[dict], bool] | None = None) -> Iterator[pa.RecordBatch]:
    """The spectra of a range, decoded; those that are not ``wanted`` by their header are skipped before they are parsed."""
    out, peaks = [], 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[c] for row in out], kind) for c, kind in KINDS.items()], names=list(KINDS))

    with opened(uri) as source:
        for element in elements(source, start, end):
            row = {"run_id": uri, **header(element)}
            if wanted and not wanted(row):
                continue
            row["mz"], row["intensity"], row["reason"] = arrays(element)
            out.append(row)
            peaks += 1 + (0 if row["mz"] is None else len(row["mz"]))
            if peaks >= PEAKS:
                yield told()
                out, peaks = [], 0
    yield told()


def byte_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(uri, start, end) of the files at ``path``, cut every ``size`` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")  # contents are not read here
    cut = files.select(file_of("path").alias("uri"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    return cut.select("uri", "start", F.least(F.col("start") + size, F.col("length")).alias("end"))


def split_files(spark: SparkSession, path: str, to: str, size: int) -> None:
    """Adds to the folder ``to`` a small file for each range of each file at ``path`` that has none yet, in the order of (uri, start).

    A stream of these files is a stream of byte positions: its log says how far each file has been read.
    """
    cut = byte_ranges(spark, path, size)
    try:
        known = spark.read.schema(RANGES).json(to).select("uri").distinct()
    except AnalysisException:  # nothing there yet
        known = None
    if known is not None:
        cut = cut.join(known, "uri", "left_anti")
    cut.repartition(1).sortWithinPartitions("uri", "start").write.option("maxRecordsPerFile", 1).mode("append").json(to)  # a row for each batch to come


def spectra_of(ranges: DataFrame, level: int | None = None, size: int = RANGE) -> DataFrame:
    """(uri, start, end) -> SPECTRA. Ranges are cut to ``size`` bytes and dealt over tasks. level: only spectra of this level, or of none, are parsed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if level is None else lambda row: row["ms_level"] in (None, 0, level)
        for b in batches:
            for row in b.to_pylist():
                yield from spectra(row["uri"], row["start"], row["end"], wanted)

    cut = ranges.select("uri", "end", F.explode(F.sequence("start", F.col("end") - 1, F.lit(size).cast("long"))).alias("start"))
    return cut.select("uri", "start", F.least(F.col("start") + size, F.col("end")).alias("end")).repartition("uri", "start").mapInArrow(read, SPECTRA)
