"""mzML files as a Spark data source: ``spark.read.format("mzml").load(path)`` gives decoded spectra.

Large files are read by ranges of bytes. Filters on ms_level, rt and spectrum_index reach the reader, which tests them on the text before a
spectrum's arrays: what they rule out is neither parsed as XML nor decoded. ms_level is 0 where a spectrum states none.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from peakfield.sources.ranges import RANGE, SPECTRA, listed, spectra

COMPARED = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}
TOLD = ("ms_level", "rt", "spectrum_index")


def holds(test: D.Filter, row: dict) -> bool:
    """Whether a filter is true, not null, of a row's header."""
    if isinstance(test, D.Not):
        inner = test.child
        return row[inner.attribute[0]] is not None and not holds(inner, row)
    value = row[test.attribute[0]]
    if isinstance(test, D.IsNull):
        return value is None
    if value is None:
        return False
    if isinstance(test, D.IsNotNull):
        return True
    return value in test.value if isinstance(test, D.In) else COMPARED[type(test)](value, test.value)


def understood(test: D.Filter) -> bool:
    inner = test.child if isinstance(test, D.Not) else test
    simple = isinstance(inner, (*COMPARED, D.In)) or (inner is test and isinstance(inner, D.IsNull | D.IsNotNull))
    return simple and len(inner.attribute) == 1 and inner.attribute[0] in TOLD


class Range(D.InputPartition):
    def __init__(self, uri: str, start: int, end: int):
        self.uri, self.start, self.end = uri, start, end


class MzmlReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size, self.tests = options["path"], int(options.get("bytesPerPartition", RANGE)), []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802  (Spark's name)
        self.tests = [f for f in filters if understood(f)]
        return [f for f in filters if not understood(f)]

    def partitions(self) -> list[Range]:
        cut = [Range(uri, at, min(at + self.size, n)) for uri, n in listed(self.path) for at in range(0, n, self.size)]
        return cut or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return

        def wanted(row: dict) -> bool:
            row["ms_level"] = row["ms_level"] or 0
            return all(holds(t, row) for t in self.tests)

        yield from spectra(partition.uri, partition.start, partition.end, wanted)


class MzmlSource(D.DataSource):
    """Options: path, a file or a folder; bytesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return SPECTRA.replace("ms_level short", "ms_level short NOT NULL")  # so that "null or 0 or 1" is "0 or 1", which can be handed on

    def reader(self, schema) -> MzmlReader:
        return MzmlReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it hand filters to sources written in Python."""
    spark.dataSource.register(MzmlSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
