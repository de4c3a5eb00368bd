"""Exact deduplication, mixing and sharding against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from peakfield.llm import curriculum, exact, sharding
from peakfield.llm.common import written


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def copies(rows):
    """rows, and hot groups of copies of some of them."""
    more = [(10_000 + k, rows[-4][1] + " " * (k % 3)) for k in range(40)] + [(20_000 + k, " \n" * k) for k in range(5)]
    return rows + more


@pytest.mark.parametrize(("primes", "chunk"), [(exact.PRIMES, exact.CHUNK), (exact.PRIMES, 7), ((3, 5), 50)])
def test_exact_groups(frame, odd_rows, primes, chunk):
    """The last case makes fingerprints collide: the comparison has to part them again."""
    rows = copies(odd_rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append((-len(t or ""), i))
    got = {r.doc_id: r for r in exact.duplicates(frame(rows), primes, chunk).collect()}
    assert len(got) == len(rows)
    for key, members in groups.items():
        for _, i in members:
            keep = min(members)[1]
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(members), i == keep, hashlib.sha256(key.encode()).hexdigest())


def test_chunk_fingerprints_compose():
    data = bytes(range(256)) * 40
    for prime in exact.PRIMES:
        table = exact.powers(prime)
        parts = [data[i : i + 777] for i in range(0, len(data), 777)]
        assert exact.combined([(len(p), exact.polynomial(p, prime, table)) for p in parts], prime) == exact.polynomial(data, prime, table)


def test_exact_stage_and_odd_input(frame):
    docs = frame([(1, "a b"), (2, "ab "), (2, "ab "), (None, "x"), (3, None)]).selectExpr("*", "1 AS fp", "2 AS part", "3 AS n", "4 AS other")
    assert {r.doc_id for r in exact.keep_one_of_each(docs).collect()} == {1, 3}
    assert exact.keep_one_of_each(docs).columns == docs.columns
    assert exact.duplicates(frame([])).count() == 0


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in stopped]
        level = (total - sum(stopped.values())) / sum(weight[s] for s in open_)
        new = {s: 3 * sizes[s] for s in open_ if 3 * sizes[s] < weight[s] * level}
        if not new:
            return stopped | {s: weight[s] * level for s in open_}
        stopped |= new


def test_mix(frame, odd_rows):
    rows = [(i, t, "en", [None, "", "b", "a", "é", "big", "tiny"][min(k % 9, 6)] if k % 3 else "big") for k, (i, t) in enumerate(odd_rows)]
    docs = frame(rows)
    mix = curriculum.mixed(written(curriculum.measured(docs), "sizes"))
    got = mix.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want, taken, most = plain_targets(sizes), Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(most[s] / 2, 1)
    again = curriculum.mixed(written(curriculum.measured(docs.repartition(3)), "sizes"))
    assert {(r.doc_id, r.copies) for r in again.collect()} == {(r.doc_id, r.copies) for r in got}
    used = Counter(r.doc_id for r in curriculum.mixture(docs).collect())
    assert used == Counter({r.doc_id: r.copies for r in got if r.copies})
    placed = curriculum.curriculum(mix).select("position").collect()
    assert [r[0] for r in placed] == sorted(r[0] for r in placed) and all(0 <= r[0] <= 1 for r in placed)


def test_mix_of_nothing(frame):
    assert curriculum.mixture(frame([])).count() == 0
    assert curriculum.mixture(frame([(1, None), (2, " ")])).count() == 0
    odd = frame([(1, "a b", "en", None), (1, "c", "en", None), (None, "x", "en", "s")]).selectExpr("*", "1 AS size", "2 AS target", "3 AS copies", "4 AS before", "'k' AS key")
    assert curriculum.mixture(odd).columns == odd.columns


@pytest.mark.parametrize("hot", [0, 150])
def test_shards(frame, odd_rows, hot):
    rows = [(i, t) for i, t in copies(odd_rows)] + [(30_000 + k, f"pair {k // 2}") for k in range(200)] + [(40_000 + k, "hot") for k in range(hot)]
    placed = sharding.shards_of(frame(rows), shards=8).collect()
    assert len(placed) == len(rows)
    by_id, text = {r.doc_id: r for r in placed}, dict(rows)
    counts = Counter(r.shard for r in placed)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(counts[s]))
    for i, t in rows:
        assert by_id[i].size == len((t or "").encode()) + 1
    pairs = [(by_id[30_000 + k].shard, by_id[30_001 + k].shard) for k in range(0, 200, 2)]
    assert sum(a != b for a, b in pairs) <= 5
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(by_id[i].shard)
    edges = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    cut = sum(a != b for g in groups.values() for k, a in enumerate(g) for b in g[:k])
    told = sharding.cut_edges(frame([(i, t) for i, t in rows]).sparkSession.createDataFrame([(r.doc_id, r.shard) for r in placed], "doc_id long, shard int"), frame(rows)).first()
    assert (int(told.cut), int(told.edges)) == (cut, edges)


def test_shards_of_odd_input(frame):
    assert sharding.shards_of(frame([])).count() == 0
    odd = frame([(1, "a"), (1, "a"), (2, None), (None, "x")]).selectExpr("*", "1 AS shard", "2 AS team", "3 AS wish", "4 AS large", "5 AS n")
    got = sharding.shards_of(odd, shards=2).collect()
    assert sorted(Counter(r.shard for r in got).values()) in ([1, 2], [3]) and len(got) == 3
