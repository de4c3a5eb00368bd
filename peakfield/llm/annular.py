"""Codes for vectors: each is cut into parts, and each part is named by the nearest entry of that part's codebook.

Codebooks are learned in rounds over all vectors: parts go to their nearest entry, entries to the floor of the mean of
their parts. All numbers are whole and distances exact, so results do not depend on how rows are dealt. The nearest entry is found by annular pruning:
entries are sorted by norm, and as distance is at least the difference of the norms, only entries whose norm is within the best distance so far of the part's
can be nearer. The interval is found by binary search, starts around the entry of the closest norm, shrinks with every better entry, and
what lies in it, its edges included, is compared exactly.

A round sends the driver sums and counts for each entry, of which there are as many as parts, entries and components make, whatever the number of rows.

Nulls: vectors that are null or hold a null or a number that is not finite go; a null vec_id comes last where the first entries are chosen, and null labels are one
label. Vectors with fewer components than the longest, or than a multiple of the parts, count as filled up with zeros. Repeated rows all
count and all get a code; ties of vec_id go by the vector. With fewer rows than entries there are as many entries as rows. An
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfield.llm.common import bounded_batches, written
from peakfield.llm.vectors import finite, kind_of, packer, shape, unpacked, whole_numbers

PARTS, ENTRIES, ROUNDS = 8, 16, 6


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of ``points``, whole numbers all; ties go to the entry that comes first."""
    norms, lengths = np.sqrt((book**2).sum(1).astype("f8")), np.sqrt((points**2).sum(1).astype("f8"))
    order = np.argsort(norms, kind="stable")
    norms, entries, last = norms[order], book[order], len(book) - 1
    slack = 1e-9 * (lengths + norms[-1]) + 1e-9  # for rounding; an entry too many does no harm
    above = np.minimum(np.searchsorted(norms, lengths), last)
    below = np.maximum(above - 1, 0)
    first = np.where(lengths - norms[below] < norms[above] - lengths, below, above)
    best, distance = order[first], ((points - entries[first]) ** 2).sum(1)

    def interval(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reach = np.sqrt(distance[rows].astype("f8")) + slack[rows]
        return np.searchsorted(norms, lengths[rows] - reach, "left"), np.searchsorted(norms, lengths[rows] + reach, "right")

    low, high = interval(np.arange(len(points)))
    for step in range(1, len(book)):
        for at in (first - step, first + step):
            rows = np.flatnonzero((at >= low) & (at < high))
            if not len(rows):
                continue
            d, entry = ((points[rows] - entries[at[rows]]) ** 2).sum(1), order[at[rows]]
            nearer = (d < distance[rows]) | ((d == distance[rows]) & (entry < best[rows]))
            rows = rows[nearer]
            best[rows], distance[rows] = entry[nearer], d[nearer]
            low[rows], high[rows] = interval(rows)
    return best, distance


def _parts(b: pa.RecordBatch, width: int, parts: int, kind: str) -> np.ndarray:
    """(rows, parts, width)"""
    return unpacked(b.column("v"), width * parts, kind, "i8").reshape(-1, parts, width)


def _summer(books: np.ndarray, kind: str):
    """A task's sums: for each part and entry the number of its parts, at -1, and their sum at each component."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        count, total = np.zeros((parts, entries), "i8"), np.zeros((parts, entries, width), "i8")
        for b in batches:
            cut = _parts(b, width, parts, kind)
            for p in range(parts):
                code, _ = nearest(cut[:, p], books[p])
                count[p] += np.bincount(code, minlength=entries)
                for e in np.unique(code):
                    total[p, e] += cut[code == e, p].sum(0)
        p, e = (x.ravel() for x in np.indices((parts, entries)))
        used = count.ravel() > 0
        whole = np.hstack([count.reshape(-1, 1), total.reshape(parts * entries, width)])[used]
        at = np.tile(np.arange(-1, width), len(whole))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p[used], width + 1)), pa.array(np.repeat(e[used], width + 1)), pa.array(at), pa.array(whole.ravel())], names=["part", "entry", "at", "total"])

    return sums


def improved(vectors: DataFrame, books: np.ndarray, kind: str) -> np.ndarray:
    """The codebooks after one round over all vectors."""
    sums = vectors.select("v").mapInArrow(_summer(books, kind), "part long, entry long, at long, total long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))
    found = {(r["part"], r["entry"], r["at"]): r["total"] for r in sums.collect()}  # parts x entries x (components + 1) rows at most
    books = books.copy()
    for (p, e, at), n in found.items():
        if at == -1:
            books[p, e] = [found[p, e, j] // n for j in range(books.shape[2])]
    return books


def _coder(books: np.ndarray, kind: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for b in batches:
            cut = _parts(b, width, parts, kind)
            found = [nearest(cut[:, p], books[p]) for p in range(parts)]
            names = ["".join(f"{c:02x}" for c in row) for row in np.stack([c for c, _ in found], 1).tolist()]
            error = np.sum([d for _, d in found], axis=0, dtype="i8")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(names, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return code


def codebooks(vectors: DataFrame, first: np.ndarray, kind: str, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, width) learned from a written table (vec_id, v). first: the vectors that entries start as."""
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = improved(vectors, books, kind)
    return books


def coded(rows: DataFrame, scale: float, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), the codebooks). rows: (vec_id, embedding, label)."""
    bounded_batches(rows.sparkSession)
    rows = finite(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    label = rows.schema["label"].dataType.simpleString()
    n, dims, peak = shape(rows, scale)
    if not n:
        return rows.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long"), np.zeros((parts, 0, 0), "i8")
    width, kind = -(-dims // parts), kind_of(peak)
    if 4 * width * parts * peak * peak >= 1 << 63:
        raise ValueError("distances that no 64 bits hold")
    vectors = written(rows.select("vec_id", "label", "embedding").mapInArrow(packer(width * parts, scale, kind, ["vec_id", "label"]), f"vec_id long, label {label}, v binary"), "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    first = whole_numbers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), width * parts, scale).astype("i8")
    books = codebooks(vectors, first, kind, parts, rounds)
    return vectors.mapInArrow(_coder(books, kind), f"vec_id long, label {label}, code string, error long"), books


def op13_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), 4096.0)
    codes = written(codes, "codes")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql() -> str:
    """One common table for each round's assignment and codebooks."""
    dot = lambda a, b: f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    assign = lambda k: f"""a{k} AS MATERIALIZED (SELECT id, p, any_value(q) AS q, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (
  SELECT id, p, t.q, b.e, CAST({dot('t.q', 't.q')} - 2 * {dot('t.q', 'b.q')} + {dot('b.q', 'b.q')} AS BIGINT) AS d FROM parts t JOIN b{k} b USING (p)) GROUP BY id, p)"""  # noqa: E731
    update = lambda k: f"""b{k + 1} AS MATERIALIZED (
  WITH m AS (SELECT p, e, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM (SELECT p, e, unnest(q) AS x, unnest(range(len(q))) AS i FROM a{k}) GROUP BY p, e, i),
  n AS (SELECT p, e, list(CAST(x AS BIGINT) ORDER BY i) AS q FROM m GROUP BY p, e)
  SELECT p, e, q FROM n UNION ALL SELECT p, e, q FROM b{k} ANTI JOIN n USING (p, e))"""  # noqa: E731
    steps = ",\n".join(f"{assign(k)},\n{update(k)}" for k in range(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (SELECT id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS q FROM kept, range({PARTS}) AS r(p)),
b0 AS MATERIALIZED (SELECT p, id - 1 AS e, q FROM parts WHERE id <= {ENTRIES}),
{steps},
{assign(ROUNDS)},
sha AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
done AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM done JOIN kept USING (id), sha
"""


ORACLE_SQL = _sql()
