"""Label propagation against plain yardsticks: shards dealt at random, and groups dealt greedily."""

import random
from collections import Counter, defaultdict

import pytest

from peakfield.llm import registry, sharding


def cut_by(shard_of, groups):
    """Pairs of a group in different shards."""
    pairs = 0
    for ids in groups.values():
        seats = Counter(shard_of[i] for i in ids)
        pairs += (len(ids) ** 2 - sum(n * n for n in seats.values())) // 2
    return pairs


def greedily(groups, n, shards):
    """The largest group first, to the emptiest shard, and what is over to the next emptiest."""
    room, shard_of = [n // shards + (s < n % shards) for s in range(shards)], {}
    for ids in sorted(groups.values(), key=len, reverse=True):
        ids = list(ids)
        while ids:
            s = max(range(shards), key=room.__getitem__)
            take, ids = ids[: room[s]], ids[room[s] :]
            room[s] -= len(take)
            shard_of |= dict.fromkeys(take, s)
    return shard_of


@pytest.mark.parametrize("sizes", [[2] * 60 + [3] * 40 + [1] * 400, [30] * 3 + [12] * 10 + [2] * 150 + [1] * 90, [260] + [2] * 100 + [1] * 300, [2] * 320])
def test_cut_against_yardsticks(frame, sizes):
    """Pairs and triples, groups of over an eighth of a shard, one that no shard can hold, and nothing but pairs."""
    rows, groups = [], defaultdict(list)
    for k, size in enumerate(sizes):
        for _ in range(size):
            groups[k].append(len(rows))
            rows.append((len(rows), f"text {k}"))
    random.Random(1).shuffle(rows)
    placed = {r.doc_id: r.shard for r in sharding.shards_of(frame(rows), 8).collect()}
    counts = Counter(placed.values())
    assert len(placed) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    rnd = random.Random(2)
    edges = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    cut, at_random, greedy = (cut_by(x, groups) for x in (placed, {i: rnd.randrange(8) for i in placed}, greedily(groups, len(rows), 8)))
    assert cut <= greedy + 0.05 * edges
    if len(ids := max(groups.values(), key=len)) <= len(rows) // 8:  # else most edges of one group have to be cut
        assert cut <= 0.5 * at_random, len(ids)


def test_large_teams_take_part(spark):
    """A large team that is found scattered comes together by the rounds, as far as the shard has room."""
    rows = [(i, 1, 0, 7 if i < 20 else None, i < 20, i % 4) for i in range(100)]
    nodes = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long, team long, large boolean, shard int")
    got = sharding.evened(sharding.propagated(nodes, 4), 4).collect()
    assert len({r.shard for r in got if r.large}) == 1
    assert set(Counter(r.shard for r in got).values()) == {25}


def test_as_registered(spark, frame, odd_rows, tmp_path):
    frame([*odd_rows, *((9_000 + i, "copied") for i in range(40)), (None, "no id")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op4_label_propagation"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted([i for i, _ in odd_rows] + list(range(9_000, 9_040)))
    counts = Counter(r.shard for r in got)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in counts)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
