"""SimHash against brute force, and what it does with odd input."""

import random

import pytest
import xxhash

from peakfield.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def invented(seed, n, size=60):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randrange(30)) for _ in range(size)) for _ in range(n)]
    rows = []
    for text in base:
        rows.append(text)
        for _ in range(rnd.randrange(4)):
            words = text.split()
            words[rnd.randrange(len(words))] = "changed"
            rows.append(" ".join(words) if rnd.random() < 0.7 else text.upper())
    rows += [None, "", " \t\n", "one", "One two", "one two", "É é É"]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return [(i * 3, rows[k]) for i, k in enumerate(order)]


def plain_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("per_tile", [2048, 3])
def test_groups_equal_brute_force(spark, per_tile):
    rows = invented(1, 40)
    want = {i: plain_fingerprint(t, 3) for i, t in rows}
    comp = plain_components(list(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    got = simhash.simhash_groups(frame(spark, rows), per_tile=per_tile).collect()
    assert {r.doc_id: r.fp[0] % 2**64 for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == comp
    assert len(got) == len(rows)


def test_near_duplicates_equal_brute_force(spark):
    rows = invented(2, 30, size=80)
    rnd = random.Random(5)
    hub = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(120))
    for i in range(60):  # copies that are near the hub, and less near each other
        words = hub.split()
        words[(at := rnd.randrange(110)) : at + 4] = ["x", f"y{i}"]
        rows.append((10_000 + i, " ".join(words)))
    rows.append((9_999, hub))

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    comp = plain_components(list(sets), lambda a, b: bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows), per_tile=16, block=700).collect()}
    assert {i: got.get(i, i) for i in sets} == comp
    kept = {r.doc_id for r in simhash.keep_one_of_each(frame(spark, rows)).collect()}
    assert kept == {i for i, c in comp.items() if i == c}


def test_empty_and_clashing_columns(spark):
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    odd = frame(spark, [(1, "a b c d"), (1, "a b c d"), (None, "x")]).selectExpr("*", "1 AS fp", "2 AS cell", "3 AS component_id", "4 AS id", "5 AS size")
    got = simhash.simhash_groups(odd).collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(1, 1), (1, 1)]
    assert simhash.keep_one_of_each(odd).count() == 1


def test_dense_spanning_links_every_component():
    import numpy as np

    rnd = np.random.default_rng(0)
    hits = np.zeros((400, 300), bool)
    hits[:200, :150] = rnd.random((200, 150)) < 0.9
    hits[250:, 200:] = True
    links = simhash.spanning(hits, same=False)
    assert all(hits[i, j] for i, j in links)
    assert len(links) == 200 + 150 - 1 + 150 + 100 - 1
