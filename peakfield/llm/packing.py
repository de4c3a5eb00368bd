"""Packing of token sequences by patterns that non-negative least squares fits to the length histogram.

Documents longer than a sequence are cut into whole sequences and a rest; nothing else is cut. The
histogram of piece lengths has as many rows as a sequence has tokens, however many documents there
are, and is all that the driver sees. There, patterns of one to three lengths that fill a sequence
exactly are enumerated, repeat counts are fitted to the histogram by non-negative least squares and
rounded down, and what the rounding leaves is packed best-fit, longest first, still as counts of
lengths. Spark then ranks the pieces of each length and looks up which repeat of which pattern, and
which place in it, the piece with that rank takes.

Nulls: a null text is an empty one (just the end id); rows without a doc_id are left out; repeated
rows are packed each. Texts of any length are cut, never shortened. Pieces of equal length take their
ranks by a hash, then doc_id, piece and content; pieces equal in all of these may take each other's
place. An empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfield.llm.common import bounded_batches, documents, hashed_buckets, named, running, written
from peakfield.llm.encoding import encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, end: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text").to_pylist(), path, end), strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, end: int, size: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as token ids with the end id, cut only where longer than ``size``."""
    bounded_batches(docs.sparkSession)
    return named(docs).mapInArrow(_cutter(path, end, size), PIECES)


def candidate_patterns(counts: np.ndarray, size: int, steps: int = 24) -> np.ndarray:
    """Patterns (a, b, c) of present lengths with sum ``size``; 0 stands for no document.

    All single and double ones, and for each length a the triples whose second length is one of
    ``steps`` quantiles of the lengths between a and what is left.
    """
    have = np.flatnonzero(counts[: size + 1])
    have = have[have > 0]
    found = [(0, 0, size)] if counts[size] else []
    found += [(0, int(a), size - int(a)) for a in have if 2 * a <= size and counts[size - a]]
    for a in have[have * 3 <= size].tolist():
        seconds = have[(have >= a) & (2 * have <= size - a)]
        seconds = seconds[counts[size - a - seconds] > 0]
        for b in seconds[np.unique(np.linspace(0, len(seconds) - 1, steps).astype(int))].tolist() if len(seconds) else []:
            found.append((a, b, size - a - b))
    return np.array(found, np.int64).reshape(-1, 3)


def disjoint(patterns: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The patterns with a gain that have more of it than any other pattern with one of their lengths; no two share a length."""
    order = np.flatnonzero(gain > 0)
    order = order[np.argsort(-gain[order], kind="stable")]
    some, place = patterns[order], np.arange(len(order))
    first = np.full(patterns.max(initial=0) + 1, len(order))
    for column in some.T:
        np.minimum.at(first, column, place)
    first[0] = len(order)  # no document
    return order[((some == 0) | (first[some] == place[:, None])).all(axis=1)]


def fit(patterns: np.ndarray, counts: np.ndarray, slack: float = 1e-5) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2; column p of A counts the lengths in pattern p.

    Coordinate descent in rounds: each takes the patterns whose exact steps lower the squares most at all of their
    lengths. As no two share a length their steps do not meet, and the best of all steps is always among them. A step never
    goes below zero; ties go to the pattern listed first. Few counts end up above zero, so that rounding loses little.
    There is no limit of rounds: the fit stops once no step would move half a repeat, or a round lowers the squares that are
    left by no more than ``slack`` of them.
    """
    x, left = np.zeros(len(patterns)), counts.astype(float)
    left[0] = 0
    if not len(patterns):
        return x
    used, zero = [patterns[:, k] for k in range(patterns.shape[1])], np.zeros(1)
    weight = sum(((u > 0) * sum((u == v).astype(float) for v in used) for u in used), zero)
    squares = float(left @ left)
    while True:
        step = np.maximum(left[patterns].sum(axis=1) / weight, -x)
        chosen = disjoint(patterns, step * step * weight)
        if np.abs(step[chosen]).max(initial=0.0) < 0.5:
            return x
        x[chosen] += step[chosen]
        for u in used:
            np.subtract.at(left, u[chosen], step[chosen])
        left[0] = 0
        before, squares = squares, float(left @ left)
        if before - squares <= slack * before:
            return x


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, repeats)] that use up the histogram ``counts`` exactly."""
    left, packed = counts.astype(np.int64).copy(), []
    patterns = candidate_patterns(left, size)
    x = fit(patterns, left)
    for k in np.argsort(-x, kind="stable").tolist():
        lengths = [int(v) for v in patterns[k] if v]
        times = min([int(x[k]), *(int(left[v]) // lengths.count(v) for v in lengths)])
        if times > 0:
            packed.append((tuple(lengths), times))
            for v in lengths:
                left[v] -= times
    return packed + best_fit(left, size)


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal sequences are filled together, and part where one count ends."""
    open_by_room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if not open_by_room[room]:
            insort(rooms, room)
        open_by_room[room].append([lengths, times])

    for v in range(size, 0, -1):
        n = int(left[v])
        while n:
            at = bisect_left(rooms, v)
            if at == len(rooms):
                each = size // v  # no open sequence has room: as many whole new ones as this length fills
                if n >= each:
                    put(size - each * v, (v,) * each, n // each)
                    n %= each
                else:
                    put(size - n * v, (v,) * n, 1)
                    n = 0
                continue
            room = rooms[at]
            lengths, times = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop(at)
            fits = min(room // v, -(-n // times))
            used = min(times, n // fits)
            if used < times:
                put(room, lengths, times - used)
            put(room - fits * v, lengths + (v,) * fits, used)
            n -= used * fits
    return [(tuple(lengths), times) for group in open_by_room.values() for lengths, times in group]


def places(packed: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, in the order of ranks, the runs of pieces that take the same place of a pattern.

    (length, first rank of the run, sequence of its first piece, offset in the sequence)
    """
    rows, used, sequence = [], defaultdict(int), 0
    for lengths, times in packed:
        offset = 0
        for v in lengths:
            rows.append((v, used[v], sequence, offset))
            used[v] += times
            offset += v
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


def _placer(table) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table.value
        key = t["length"].to_numpy() * (1 << 44) + t["first"].to_numpy()
        for f in frames:
            at = np.searchsorted(key, f["length"].to_numpy() * (1 << 44) + f["rank"].to_numpy(), side="right") - 1
            f["sequence_id"] = t["sequence"].to_numpy()[at] + f["rank"].to_numpy() - t["first"].to_numpy()[at]
            f["offset"] = t["offset"].to_numpy()[at]
            yield f[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack(cut: DataFrame, size: int) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut`` must be a written table: it is read twice.

    A length may belong to a third of all pieces; ranks are counted in hash buckets of pieces, so
    no window holds a whole length.
    """
    spark = cut.sparkSession
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    counts = np.zeros(size + 1, np.int64)
    for v, n in hist.items():
        counts[v] = n
    table = spark.sparkContext.broadcast(places(plan(counts, size)))
    n_buckets = hashed_buckets(max(hist.values(), default=0))
    ranked = running(cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets))), ["length"], "bucket", ["doc_id", "piece", "ids_crc32"], F.lit(1), "rank")
    return ranked.drop("bucket").mapInPandas(_placer(table), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end: int, size: int = 2048) -> DataFrame:
    return pack(written(pieces(docs, path, end, size), "pieces"), size)


def op10_pattern_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json", end: int = 0, size: int = 2048) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path(vocabulary), end, size)
