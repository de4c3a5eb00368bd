"""Exact top-k search and vector codes against brute force over whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfield.llm import annular, balltree

ROWS = "vec_id long, embedding array<float>, label int"


def vectors(n, dims, seed, copies=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dims))
    x = (centres[rnd.integers(0, 5, n)] + rnd.normal(scale=0.4, size=(n, dims))).astype("f4")
    if copies:
        x[rnd.choice(n, copies, replace=False)] = x[0]
    return [(int(i), [float(v) for v in row], int(i) % 3 if i % 7 else None) for i, row in enumerate(x)]


ODD = [(7, None, 1), (50, None, 1), (100, [1.0, None], 0), (150, [float("nan")] * 2, 0), (200, [float("inf"), 0.0], 0), (None, [1.0, 2.0], 5)]


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_top(rows, every, k, scale):
    kept = {}
    for i, v, _ in rows:
        if i is not None and good(v):
            kept[i] = max(kept.get(i, v), v)
    kept = {i: whole(v, scale) for i, v in kept.items()}
    out = set()
    for q, a in kept.items():
        if q % every == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept.items() if i != q))[:k]
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("shard,leaf,block,slice_", [(40, 4, 7, 4), (100, 64, 1024, 2048), (10_000, 16, 3, 1)])
def test_top_k_equals_brute_force(spark, shard, leaf, block, slice_):
    rows = vectors(400, 16, 1, copies=130)
    got = balltree.top_k(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 20 == 0, 5, 256.0, shard, leaf, block, slice_)
    assert {tuple(r) for r in got.collect()} == plain_top(rows, 20, 5, 256)


def test_top_k_at_odd_rows(spark):
    rows = [*ODD, (0, [0.5, -0.25], 1), (20, [], 1), (40, [1.0], 1), (40, [0.25, 3.0], 1), (40, [1.0], 1), (60, [-2.0, 0.001, 4.0], 1), (61, [-0.001], 0)]
    df = spark.createDataFrame(rows, ROWS).withColumn("score", F.lit("clash")).withColumn("shard", F.lit("clash"))
    padded = [(i, None if v is None else v + [0.0] * (3 - len(v)), x) for i, v, x in rows]
    padded = [r for r in padded if r[0] != 40] + [(40, [1.0, 0.0, 0.0], 1)]  # of rows that share a vec_id the greatest
    got = {tuple(r) for r in balltree.top_k(df, F.col("vec_id") % 20 == 0, 5, 256.0).collect()}
    assert got == plain_top(padded, 20, 5, 256)
    assert len({r[0] for r in got}) == 4
    for few in ([], [(0, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 1)]):
        assert balltree.top_k(spark.createDataFrame(few, ROWS), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_nodes_below_the_kth_score_are_not_scored():
    rnd = np.random.default_rng(5)
    points = np.concatenate([rnd.normal(loc=200 * np.eye(8)[c], scale=5, size=(256, 8)) for c in range(8)]).round()
    order, spans, centres, radii = balltree.ball_tree(points, 16)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(key)
            return super().__getitem__(key)

    q = 100 * np.eye(8)[3:4]
    scores, ids = balltree.branch_and_bound((spans, centres, radii), points[order].view(Counted), order, q, np.array([-1]), np.array([balltree.NONE]), 5)
    want = sorted((-(points @ q[0]).astype(int)).tolist())[:5]
    assert [-s for s in scores[0].tolist()] == want
    assert 0 < len(seen) <= 256 // 8 < len(spans) // 2  # the leaves of one of eight clusters at most


def test_trees_hold_their_vectors():
    points = np.random.default_rng(2).integers(-50, 50, (300, 4)).astype("f8")
    order, spans, centres, radii = balltree.ball_tree(points, 8)
    assert sorted(order.tolist()) == list(range(300))
    for (start, end, child), centre, radius in zip(spans, centres, radii):
        assert (np.sqrt(((points[order[start:end]] - centre) ** 2).sum(1)) <= radius + 1e-9).all()
        if child:
            assert spans[child][0] == start and spans[child][1] == spans[child + 1][0] and spans[child + 1][1] == end


def plain_codes(rows, scale, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if good(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = max((len(r[1]) for r in kept), default=0)
    width = -(-dims // parts)
    cut = [[(whole(r[1], scale) + [0] * (width * parts))[: width * parts][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[cut[i][p] for i in range(min(entries, len(kept)))] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            to = [near(p, c[p])[1] for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, to) if k == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted((repr(r[0]), "".join(f"{k:02x}" for _, k in f), e, by[r[2]], sha) for r, f, e in zip(kept, found, errors))


def registered(spark, tmp_path, rows):
    spark.createDataFrame(rows, ROWS).withColumn("code", F.lit("clash")).repartition(3).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    return f"file://{tmp_path}"


@pytest.mark.parametrize("rows", [vectors(300, 16, 3, copies=90) + ODD[:5], vectors(9, 8, 4) + [(0, [1.0] * 8, 1), (0, [1.0] * 8, 1)], [(5, [1.0, 2.0, 3.0], None), (None, [0.5] * 11, 2), (6, [], 2)]])
def test_codes_equal_brute_force(spark, tmp_path, rows):
    got = annular.op13_annular_codes(spark, registered(spark, tmp_path, rows)).collect()
    assert sorted((repr(r[0]), *tuple(r)[1:]) for r in got) == plain_codes(rows, 4096)


def test_codes_of_nothing(spark, tmp_path):
    assert annular.op13_annular_codes(spark, registered(spark, tmp_path, ODD[:5])).count() == 0


def test_top_k_as_registered(spark, tmp_path):
    rows = vectors(260, 16, 6) + ODD
    got = balltree.op12_ball_tree(spark, registered(spark, tmp_path, rows))
    assert {tuple(r) for r in got.collect()} == plain_top(rows, 50, 5, 256)


def test_annulus_is_exact_at_its_edges():
    """Whole grids are full of equal distances and norms."""
    grid = np.stack(np.meshgrid(*[np.arange(-4, 5)] * 2), -1).reshape(-1, 2)
    book = grid[np.random.default_rng(8).permutation(len(grid))[:16]]
    code, distance = annular.nearest(grid, np.concatenate([book, book[:4]]))
    every = ((grid[:, None] - book) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (code == every.argmin(1)).all()
