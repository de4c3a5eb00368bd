"""What the operators on vectors share: which rows take part, and their components as whole numbers in one fixed width."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(rows: DataFrame) -> DataFrame:
    """The rows whose ``embedding`` is there and holds neither nulls nor numbers that are not finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", good), F.lit(True)))


def shape(rows: DataFrame, scale: float) -> tuple[int, int, int]:
    """(rows, the most components, the greatest whole number) of finite rows, in one pass."""
    peak = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    n, dims, most = rows.agg(F.count("*"), F.max(F.size("embedding")), F.max(peak)).first()
    most = (most or 0.0) * scale + 1
    if most >= 2.0**31:
        raise ValueError(f"components of {most:.3g} after scaling, 2**31 being the limit")
    return n, dims or 0, int(most)


def kind_of(peak: int) -> str:
    """The narrowest type that holds whole numbers up to ``peak``."""
    return "<i2" if peak < 1 << 15 else "<i4"


def whole_numbers(column: pa.ListArray, dims: int, scale: float) -> np.ndarray:
    """(rows, dims) of floor(scale * x); shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), dims), "f8")
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype("f8"))
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out[np.arange(dims)[None, :] < sizes[:, None]] = values
    return out


def packer(dims: int, scale: float, kind: str, rest: list[str]):
    """A task that replaces ``embedding`` by ``v``, its whole numbers as bytes; the columns of ``rest`` stay."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = whole_numbers(b.column("embedding"), dims, scale).astype(kind)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([x.tobytes() for x in numbers], pa.binary())], names=[*rest, "v"])

    return pack


def unpacked(values: pa.Array | list[bytes], dims: int, kind: str, to: str = "f8") -> np.ndarray:
    """(rows, dims) from a column or list of packed vectors."""
    data = values.to_pylist() if isinstance(values, pa.Array | pa.ChunkedArray) else values
    return np.frombuffer(b"".join(data), kind).reshape(len(data), dims).astype(to)
