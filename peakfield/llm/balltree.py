"""Exact top-k search by inner product: a ball tree in each shard, searched by branch and bound.

Vectors are dealt to cells, the nearest of the centres that a sample of ``SAMPLE`` rows is split into, so that shards lie close
together; every row has a cell, and a cell that is too large for one shard is cut by a hash. Each shard of about ``SHARD`` vectors
becomes one row: its vectors in the order of a ball tree, and the tree. No inner product of a query q within a ball exceeds
q.centre + |q| * radius. A block of queries goes through a tree together: the node with the greatest bound
comes first, queries whose kth score is above a node's bound leave it, and what is left at a leaf is scored exactly.

Queries come in blocks. Rounds share the current kth scores between shards: in each round a query visits the
next of its shards by bound, four times as many as before, unless the bound is below its kth score by then. A pair of a block and a
shard is a row of a few megabytes, so pairs spread over tasks whatever shard is popular.

Nulls: rows without a vec_id, vectors that are null or hold a null or a number that is not finite take no part. Vectors with fewer components
than the longest count as filled up with zeros, an empty one has score 0. Ties go to the smaller vec_id. Rows that share
a vec_id count as one, with the greatest vector. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfield.llm.common import bounded_batches, hashed_buckets, written
from peakfield.llm.vectors import finite, kind_of, packer, shape, unpacked

#: Rows that cells are drawn from, cells at most, vectors of a shard, of a leaf, queries of a block, shards whose bounds are looked at together.
SAMPLE, CELLS, SHARD, LEAF, BLOCK, SLICE = 4096, 1024, 4096, 64, 1024, 2048
#: The score of nothing.
NONE = -(2**63 - 1)


def split(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the rows, as numbers of rows, along the line between two that lie far apart."""
    far = lambda x: int(np.argmax(((points - x) ** 2).sum(1)))
    a = points[far(points.mean(0))]
    along = (points - a) @ (points[far(a)] - a)
    order = np.argpartition(along, len(points) // 2)
    return order[: len(points) // 2], order[len(points) // 2 :]


def ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    centre = points.mean(0)
    return centre, float(np.sqrt(((points - centre) ** 2).sum(1).max())) * (1 + 1e-12)


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, spans (start, end, first child or 0), centres, radii). A node's children are beside each other."""
    order, spans, balls, at = np.arange(len(points)), [[0, len(points), 0]], [ball(points)], 0
    while at < len(spans):
        start, end, _ = spans[at]
        if end - start > leaf:
            own = order[start:end]
            halves = [own[h] for h in split(points[own])]
            order[start:end] = np.concatenate(halves)
            spans[at][2], cut = len(spans), start + len(halves[0])
            for (s, e), half in zip(((start, cut), (cut, end)), halves, strict=True):
                spans.append([s, e, 0])
                balls.append(ball(points[half]))
        at += 1
    return order, np.array(spans, "i8"), np.array([b[0] for b in balls]), np.array([b[1] for b in balls])


def bounds(queries: np.ndarray, lengths: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """(queries, balls): no inner product of a query with a vector inside a ball is greater; a little is added for rounding."""
    sizes = np.sqrt((centres**2).sum(1)) + radii
    return queries @ centres.T + lengths[:, None] * radii + 1e-9 * lengths[:, None] * sizes + 1e-6


def branch_and_bound(tree: tuple, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), each (queries, k), best first, of a shard's vectors; only scores of ``least`` or more are looked for.

    Vectors and ids are in the tree's order. Entries without a score are NONE.
    """
    spans, centres, radii = tree
    lengths = np.sqrt((queries.astype("f8") ** 2).sum(1))
    q = queries.astype("f8")
    scores, found, floor = np.full((len(q), k), NONE, "i8"), np.full((len(q), k), 2**63 - 1, "i8"), least.astype("i8").copy()
    every = np.arange(len(q))
    reach = bounds(q, lengths, centres[:1], radii[:1])[:, 0]
    heap = [(-float(reach.max(initial=-np.inf)), 0, every, reach)]
    while heap:
        _, node, active, reach = heapq.heappop(heap)
        active = active[reach >= floor[active]]
        if not len(active):
            continue
        start, end, child = spans[node]
        if child:
            both = bounds(q[active], lengths[active], centres[child : child + 2], radii[child : child + 2])
            for j in (0, 1):
                heapq.heappush(heap, (-float(both[:, j].max()), int(child) + j, active, both[:, j]))
            continue
        exact = queries[active] @ vectors[start:end].T
        exact = np.where(query_ids[active][:, None] == ids[start:end], NONE, exact.astype("i8"))
        hit = (exact >= floor[active][:, None]).any(1) & (exact > NONE).any(1)
        if hit.any():
            rows = active[hit]
            more, names = np.hstack([scores[rows], exact[hit]]), np.hstack([found[rows], np.broadcast_to(ids[start:end], (len(rows), end - start))])
            best = np.lexsort((names, -more), axis=1)[:, :k]
            scores[rows], found[rows] = np.take_along_axis(more, best, 1), np.take_along_axis(names, best, 1)
            floor[rows] = np.maximum(floor[rows], scores[rows][:, -1])
    return scores, found


def _nearest(centres: np.ndarray, dims: int, kind: str):
    """A task that adds each vector's cell, the nearest of ``centres``."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (centres**2).sum(1) / 2
        for b in batches:
            cell = np.argmax(unpacked(b.column("v"), dims, kind) @ centres.T - lengths, axis=1).astype("i4")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell)], names=["vec_id", "v", "cell"])

    return assign


def cells_of(sample: np.ndarray, most: int) -> np.ndarray:
    """Centres of ``most`` cells, or as many as differ, that the sample is split into."""
    parts = [np.arange(len(sample))]
    while len(parts) < most and len(parts[0]) > 1:
        parts.sort(key=len, reverse=True)
        own = parts.pop(0)
        parts += [own[h] for h in split(sample[own])]
    return np.unique(np.array([sample[p].mean(0) for p in parts]), axis=0)


def _trees(dims: int, kind: str, leaf: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, members in zip(b.column("shard").to_pylist(), b.column("members"), strict=True):
                points = unpacked(members.values.field("v"), dims, kind)
                order, spans, centres, radii = ball_tree(points, leaf)
                ids = members.values.field("vec_id").to_numpy()[order]
                row = [[x] for x in (shard, ids.tobytes(), points[order].astype(kind).tobytes(), spans.tobytes(), centres.tobytes(), radii.tobytes(), centres[0].tobytes(), float(radii[0]))]
                kinds = [pa.int64(), *[pa.binary()] * 6, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["shard", "ids", "vectors", "spans", "centres", "radii", "centre", "radius"])

    return build


SHARDS = "shard long, ids binary, vectors binary, spans binary, centres binary, radii binary, centre binary, radius double"


def shards_of(vectors: DataFrame, n: int, dims: int, kind: str, shard: int = SHARD, leaf: int = LEAF, cells: int = CELLS, sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """(a written row for each shard, how many shards). vectors: a written table (vec_id, v)."""
    few = [bytes(r["v"]) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    centres = cells_of(unpacked(few, dims, kind), min(cells, hashed_buckets(n, shard)))
    dealt = written(vectors.mapInArrow(_nearest(centres, dims, kind), "vec_id long, v binary, cell int"), "cells")
    sizes = dict(dealt.groupBy("cell").count().collect())  # a row for each cell
    parts, offsets, total = [], [], 0
    for cell in range(len(centres)):
        parts.append(hashed_buckets(sizes.get(cell, 0), shard))
        offsets.append(total)
        total += parts[-1]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    number = (pick(offsets) + F.pmod(F.xxhash64("vec_id"), pick(parts))).cast("long")
    grouped = dealt.groupBy(number.alias("shard")).agg(F.collect_list(F.struct("vec_id", "v")).alias("members"))
    return written(grouped.mapInArrow(_trees(dims, kind, leaf), SHARDS), "shards"), total


def _planner(dims: int, kind: str, lo: int, hi: int):
    """A task that gives, for a block of queries and a slice of shards, the shards that come lo-th to hi-th by bound for each query, and the queries that want them."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                q = unpacked(row["vs"], dims, kind)
                centres = np.frombuffer(b"".join(x["centre"] for x in row["balls"])).reshape(-1, dims)
                reach = bounds(q, np.sqrt((q**2).sum(1)), centres, np.array([x["radius"] for x in row["balls"]]))
                order = np.argsort(-reach, axis=1, kind="stable")
                chosen = order[:, lo:hi]
                wants = np.take_along_axis(reach, chosen, 1) >= np.array([NONE if x is None else x for x in row["least"]])[:, None]
                who, which = np.nonzero(wants)[0], chosen[wants]
                for j in np.unique(which):
                    out.append((row["block"], row["balls"][j]["shard"], who[which == j].astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["block", "shard", "who"])

    return plan


def _searcher(dims: int, kind: str, k: int, exact: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                who = np.frombuffer(row["who"], "<i4")
                q = unpacked(row["vs"], dims, kind, exact)[who]
                names = np.array(row["ids"], "i8")[who]
                least = np.array([NONE if x is None else x for x in row["least"]], "i8")[who]
                spans, centres, radii = (np.frombuffer(row[c], t) for c, t in (("spans", "i8"), ("centres", "f8"), ("radii", "f8")))
                tree = (spans.reshape(-1, 3), centres.reshape(-1, dims), radii)
                ids = np.frombuffer(row["members"], "i8")
                vectors = np.frombuffer(row["vectors"], kind).reshape(-1, dims).astype(exact)
                scores, found = branch_and_bound(tree, vectors, ids, q, names, least, k)
                at = np.nonzero((scores > NONE) & (scores >= least[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(names[at[0]]), pa.array(found[at]), pa.array(scores[at])], names=["query_id", "vec_id", "score"])

    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(rows: DataFrame, asks: Column, k: int, scale: float = 1.0, shard: int = SHARD, leaf: int = LEAF, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``asks`` holds for, the k other rows with the highest inner products of floor(scale * x).

    rows: (vec_id, embedding). asks: a condition on vec_id.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = finite(rows.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():  # the id column alone is read
        rows = rows.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    n, dims, peak = shape(rows, scale)
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    if not n:
        return _ranked(best, k).select("query_id", "rank", "vec_id", "score")
    if dims * peak * peak >= 1 << 63:
        raise ValueError("scores that no 64 bits hold")
    kind, exact = kind_of(peak), "f8" if dims * peak * peak < 1 << 53 else "i8"  # both are exact
    vectors = written(rows.mapInArrow(packer(dims, scale, kind, ["vec_id"]), "vec_id long, v binary"), "vectors")
    shards, n_shards = shards_of(vectors, n, dims, kind, shard, leaf)
    ball = F.struct("shard", "centre", "radius")
    slices = written(shards.groupBy(F.expr(f"shard div {slice_}").alias("slice")).agg(F.collect_list(ball).alias("balls")), "slices")
    n_slices = -(-n_shards // slice_)
    queries = written(vectors.where(asks), "queries")
    number = F.pmod(F.xxhash64("vec_id"), F.lit(hashed_buckets(queries.count(), block))).cast("long").alias("block")
    queries = queries.select(number, "vec_id", "v")
    inside = lambda c: F.transform("q", lambda x: x[c])
    blocks = written(queries.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("q")).select("block", inside("vec_id").alias("ids"), inside("v").alias("vs")), "blocks")
    lo, hi = 0, 1
    while lo < min(n_shards, slice_):
        kth = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        floors = queries.select("block", "vec_id").join(kth, "vec_id", "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "least"))).alias("q"))
        asked = written(blocks.join(floors.select("block", inside("least").alias("least")), "block"), "asked")
        met = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1)))).join(slices, "slice").select("block", "vs", "least", "balls")
        pairs = written(met.mapInArrow(_planner(dims, kind, lo, hi), "block long, shard long, who binary"), "pairs")
        full = pairs.join(asked, "block").join(shards.withColumnRenamed("ids", "members").drop("centre", "radius"), "shard")
        found = full.repartition("block", "shard").mapInArrow(_searcher(dims, kind, k, exact), "query_id long, vec_id long, score long")
        best = written(_ranked(best.unionByName(found), k).drop("rank"), "best")
        lo, hi = hi, hi + 4 * (hi - lo)
    return _ranked(best, k).select("query_id", "rank", "vec_id", "score")


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 50 == 0, 5, 256.0)


ORACLE_SQL = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM kept q JOIN kept c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 5
"""
