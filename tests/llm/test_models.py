"""Language identification, the hidden Markov model and SpotSigs against plain versions and held-out texts."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from peakfield.llm import hmm, langid, spotsigs
from peakfield.llm.common import crc_of_id, written

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it".split(), "fr": "qu ou ai en le de re nt on eau eux que ment tion la es é è".split(), "de": "en er ch de ei un nd ie in ge sch auf das der und ich".split()}


def corpus(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        text = " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.choice([1, 1, 2, 3]))) for _ in range(rnd.randrange(20, 80)))
        rows.append((i, text, lang, "s"))
    return rows


def test_language(frame):
    rows = [(i, t, lang if i % 5 else None, s) for i, t, lang, s in corpus(400)] + [(900, None, "en", "s"), (901, "12 34 !?", "en", "s"), (902, "", None, "s"), (903, "語", None, "s"), (None, "the", "en", "s")]
    got = {r.doc_id: r for r in langid.predicted(frame(rows)).collect()}
    assert len(got) == len(rows) - 1
    for i in range(400):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
    held = [r for r in corpus(400) if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred in SYLLABLES
    kept = {r.doc_id: r.lang for r in langid.identified(frame(rows)).collect()}
    assert set(kept) == {i for i, r in got.items() if r.lang_pred != "und" and r.score >= 0.5} and set(range(400)) <= set(kept)
    assert all(kept[i] == (lang or got[i].lang_pred) for i, _, lang, _ in rows[:400])


def learned(frame, rows):
    return langid.Model(*langid.learn(frame(rows)).parts)


def test_language_backs_off_to_grams(frame):
    """A text of words that training never saw is told by its grams."""
    model = learned(frame, corpus(300))
    model.at[0].clear()
    rows = corpus(60, seed=9)
    assert sum(model.predict(t)[0] == lang for _, t, lang, _ in rows) >= 57


def test_every_word_and_gram_of_the_sample_is_kept(frame):
    """However frequent: nothing that was counted is left out."""
    rows = [(i, t * (20 if lang == "en" else 1), lang, s) for i, t, lang, s in corpus(300)]
    model = learned(frame, rows)
    words = {w for _, t, _, _ in rows for w in langid.words_of(t)}
    assert set(model.at[0]) == words
    for k in range(1, langid.LONGEST + 1):
        assert set(model.at[k]) == {g for w in words for g in langid.grams(w, k)}


@pytest.mark.parametrize("remembered", [200_000, 50])
def test_predictions_equal_a_plain_version(frame, monkeypatch, remembered):
    """lang_pred and score from counts of the rows that are not held out, word by word."""
    monkeypatch.setattr(langid, "REMEMBERED", remembered)
    rows = corpus(200) + [(500 + i, " ".join(w[::-1] for w in t.split()) + " हिन्दी x1y", lang, s) for i, t, lang, s in corpus(40, seed=8)]
    langs = sorted(SYLLABLES)
    counts, n_rows = {(lang, k): Counter() for lang in langs for k in range(6)}, Counter()
    for i, t, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            n_rows[lang] += 1
            for w in re.findall(r"[^\W\d_\u0900-\u0fff]+|[\u0900-\u0fff]+", t.lower()):
                counts[lang, 0][w] += 1
                for k in range(1, 6):
                    counts[lang, k].update(langid.grams(w, k))
    log = lambda k, g: [math.log((counts[x, k][g] + 0.5) / (sum(counts[x, k].values()) + 0.5 * len(counts[x, k]) + 1)) for x in langs]
    have = [set().union(*(counts[x, k] for x in langs)) for k in range(6)]
    got = {r.doc_id: r for r in langid.predicted(frame(rows)).collect()}
    model = learned(frame, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1])
    for i, t, _, _ in rows[::7] + rows[-10:]:
        total = [math.log(n_rows[x] / sum(n_rows.values())) for x in langs]
        for w in re.findall(r"[^\W\d_\u0900-\u0fff]+|[\u0900-\u0fff]+", t.lower()):
            if w in have[0]:
                add = log(0, w)
            else:
                k = next((k for k in range(5, 0, -1) if any(g in have[k] for g in langid.grams(w, k))), None)
                found = [g for g in langid.grams(w, k) if g in have[k]] if k else []
                add = [sum(x) / len(found) for x in zip(*(log(k, g) for g in found), strict=True)] if found else [0.0] * len(langs)
            total = [a + b for a, b in zip(total, add, strict=True)]
        best = max(total)
        assert got[i].lang_pred == langs[total.index(best)]
        assert got[i].score == pytest.approx(1 / sum(math.exp(x - best) for x in total))
        assert model.predict(t) == (got[i].lang_pred, got[i].score)


def test_words_of_scripts_with_marks_are_whole():
    assert langid.words_of("हिन्दी, İx é1z _a") == ["हिन्दी", "i̇x", "é", "z", "a"]


def test_language_of_nothing(frame):
    assert langid.predicted(frame([])).count() == 0
    assert [r.lang_pred for r in langid.predicted(frame([(1, "word", None, "s")])).collect()] == ["und"]
    odd = frame([(1, "a", "en", "s"), (1, "a", "en", "s")]).selectExpr("*", "1 AS held_out", "2 AS score", "3 AS n", "4 AS gram")
    assert langid.predicted(odd).count() == 2


def plain_likelihood(tokens, start, move, emit):
    a = start * emit[tokens[0]]
    for t in tokens[1:]:
        a = (a @ move) * emit[t]
    return math.log(a.sum())


def small_model(states=3, classes=7, seed=1):
    rnd = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return norm(rnd.random(states), 0), norm(rnd.random((states, states)), 1), norm(rnd.random((classes, states)), 0)


def tokenised(text):
    """Its row from the hidden Markov model's tokeniser, which knows the words a and bc, and the counted words."""
    keys = np.sort(np.array([hmm.word_hash(w) for w in (b"a", b"bc")]))
    shared = SimpleNamespace(value=(keys, np.array([3, 4]), np.array([1 + hmm.HASHED, 0])))
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([False]), pa.array([text])], ["doc_id", "held_out", "text"])])
    [row] = [r for b in hmm._tokeniser(shared)(batch()) for r in b.to_pylist()]
    words, rare = Counter(), Counter()
    for b in hmm._word_counter(batch()):
        words.update({r["h"]: r["n"] for r in b.to_pylist()})
    for h, n in zip(row.pop("rare"), row.pop("times"), strict=True):
        rare[h] += n
    return row, rare, words


def test_words_of_a_text_in_pieces(monkeypatch):
    """Cut anywhere, no word is cut, lost or counted twice."""
    for text in ("", " ", "a", "a bc éa\x0bÉ语 语 語語 A\n\n bc\tlong-word-here ", " a" * 40, "x" * 90 + " a", "x" * 90):
        monkeypatch.setattr(hmm, "PIECE", 1 << 20)
        row, rare, words = tokenised(text)
        assert words.total() + 1 == row["n_tokens"] == len(text.split()) + 1
        for piece in (1, 3, 7, 20):
            monkeypatch.setattr(hmm, "PIECE", piece)
            cut = tokenised(text)
            assert cut[0].pop("logs") == pytest.approx(row["logs"])
            assert cut == ({k: v for k, v in row.items() if k != "logs"}, rare, words)


def test_memory_of_a_long_text_is_bounded():
    """Of a text of many pieces only its classes are held: two bytes a token, some more while they are put together."""
    text = "a bc d " * 9_000_000  # 63 MB, 27 million words
    tracemalloc.start()
    row, _, words = tokenised(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row["n_tokens"] == 27_000_001 and sorted(words.values()) == [9_000_000] * 3
    assert peak < 8 * len(text)


def test_forward_and_expected_counts():
    start, move, emit = small_model()
    rnd = np.random.default_rng(2)
    seqs = [rnd.integers(0, 7, n) for n in (1, 5, 5, 9, 2)]
    first, moves, emitted, likelihood = hmm.expected(seqs, start, move, emit)
    for window in (1, 2, 4, 5):  # cuts change nothing
        for x, y in zip(hmm.expected(seqs, start, move, emit, window), (first, moves, emitted, likelihood), strict=True):
            assert x == pytest.approx(y)
    assert likelihood == pytest.approx(sum(plain_likelihood(s, start, move, emit) for s in seqs))
    assert first.sum() == pytest.approx(5) and moves.sum() == pytest.approx(sum(len(s) - 1 for s in seqs))
    assert emitted.sum(axis=1) == pytest.approx(np.bincount(np.concatenate(seqs), minlength=7))
    # posterior counts by listing every path of one sequence
    s, total, by_state = seqs[1], 0, np.zeros(3)
    for path in np.ndindex(*(3,) * len(s)):
        p = start[path[0]] * emit[s[0], path[0]] * math.prod(move[a, b] * emit[s[k + 1], b] for k, (a, b) in enumerate(zip(path, path[1:], strict=False)))
        total += p
        by_state += p * np.bincount(path, minlength=3)
    assert hmm.expected([s], start, move, emit)[2].sum(axis=0) == pytest.approx(by_state / total)


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_scores(frame, most):
    """The base score, by brute force, whatever share of the words is broadcast; and the model is better than it."""
    rows = [(i, t) for i, t, _, _ in corpus(250)] + [(900, None), (901, "NEVER seen Words"), (902, " \n")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts, n_train = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update((t or "").encode().lower().split())
            n_train += 1
    counts[None] = n_train
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in hmm.scored(frame(rows), F.pmod(crc_of_id(), F.lit(7)) == 2, most=most).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens))
    out = [r for r in got.values() if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.05 * sum(r.n_tokens for r in out)


@pytest.mark.parametrize("own", [20, 0, 10**4])
def test_score_is_the_models(frame, monkeypatch, own):
    """score = log10 of the forward probability of the classes times each word's part of its class, over whole texts."""
    model = {}
    real = hmm.trained
    monkeypatch.setattr(hmm, "trained", lambda train, mass, n, states: model.setdefault("m", real(train, mass, n, states, least_gain=0.2)))
    rows = [(i, t) for i, t, _, _ in corpus(40)] + [(100, " ".join(t for _, t, _, _ in corpus(5, seed=3)))]
    got = {r.doc_id: r for r in hmm.scored(frame(rows), F.lit(False), own_most=own).collect()}
    counts = Counter(w for _, t in rows for w in t.encode().lower().split())
    best = sorted(counts, key=lambda w: (-counts[w], hmm.word_hash(w)))[:own]
    at = {w: 1 + hmm.word_hash(w) % hmm.HASHED for w in counts} | {w: 1 + hmm.HASHED + k for k, w in enumerate(best)}
    mass = Counter({0: len(rows) + 1})
    for w, c in counts.items():
        mass[at[w]] += c + 1 + (at[w] <= hmm.HASHED and not mass[at[w]])
    start, move, emit = model["m"]
    for i, t in [*rows[:10], rows[-1]]:
        words = t.encode().lower().split()
        a, want = start, 0.0
        for k, c in enumerate([*(at[w] for w in words), 0]):
            a = (a @ move if k else a) * emit[c]
            want += math.log10(a.sum())
            a = a / a.sum()
        want += sum(math.log10((counts[w] + 1) / mass[at[w]]) for w in words)
        assert got[i].score == pytest.approx(want)


def test_rounds_end_by_likelihood_over_all_documents(spark, frame, monkeypatch):
    """Every round reads every training document; training stops when a round gains little, not after a number of rounds."""
    read, real = [], hmm.round_of
    monkeypatch.setattr(hmm, "round_of", lambda train, model: read.append((train.count(), (out := real(train, model))[1])) or out)
    hmm.scored(frame([(i, t) for i, t, _, _ in corpus(120)]), F.col("doc_id") % 10 == 0).count()
    assert {n for n, _ in read} == {108} and len(read) >= 3
    gains = [b - a for (_, a), (_, b) in zip(read, read[1:], strict=False)]
    assert all(g > 0 for g in gains[:-1])


def test_long_and_tied_texts(frame):
    rows = [(1, "b a " * 20_000), (2, "a b " * 20_000), (3, "\n"), (4, None), (5, "b a " * 20_000)]
    got = {r.doc_id: r for r in hmm.scored(frame(rows), F.lit(False)).collect()}
    assert got[1].n_tokens == 40_001 and got[1].score == got[5].score and got[3].score == got[4].score
    assert all(math.isfinite(r.score) for r in got.values())


def test_scores_of_nothing(frame):
    assert hmm.scored(frame([]), F.lit(False)).count() == 0
    r = hmm.scored(frame([(1, "a b"), (1, "a b"), (None, "x")]).selectExpr("*", "1 AS h", "2 AS n", "3 AS classes"), F.lit(True)).collect()
    assert len(r) == 1 and r[0].base_score == 0 and math.isfinite(r[0].score)


ANCHORS = ["and", "of", "the"]


def plain_anchors(rows, share=0.1):
    n = Counter(w for _, t in rows for w in {w for w in re.split(r"[\W_]+", (t or "").lower()) if w})
    return [w for w, k in n.items() if k >= share * len(rows) and k > 1]


def plain_spots(text, anchors=ANCHORS):
    """The chains as tuples of words, by a walk."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    at = [k for k, w in enumerate(words) if w not in anchors]
    every = [(words[k - 1] if k else "", words[k], words[at[i + 1]] if i + 1 < len(at) else "") for i, k in enumerate(at)]
    starts = [i for i, c in enumerate(every) if c[0] == "" or c[0] in anchors]
    if not every:
        return {(" ".join(words),)} if words else set()
    if len(every) <= 8 or 8 * len(starts) < len(every):
        return set(every)
    chains = {every[i] for i in starts}
    for i, j in zip(starts, [*starts[1:], len(every)], strict=True):
        if j - i >= 32:
            chains |= set(every[i:j])
    return chains


def plain_print(chains):
    out = set()
    for chain in chains:
        h = 42
        for word in chain:
            h = xxhash.xxh64_intdigest(word.encode(), h)
        out.add(h & 0xFFFFFFFF)
    return "".join(f"{x:08x}" for x in sorted(out))


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def plain_groups(sets, similarity=0.8):
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= similarity and comp[a] != comp[b]:
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {i: new if c == old else c for i, c in comp.items()}
    return comp


def test_fingerprints_edits_and_likenesses(spark, frame, odd_rows, tmp_path):
    rows = odd_rows + [(9000 + i, " ".join(f"слово{i * 3 + k}" for k in range(n))) for i, n in enumerate((2, 7, 9, 40))]
    frame(rows).selectExpr("*", "1 AS fp", "2 AS need", "3 AS head", "4 AS n_chars2", "5 AS component_id").write.parquet(f"{tmp_path}/documents.parquet")
    anchors, order = plain_anchors(rows), sorted(rows, reverse=True)
    assert 5 < len(anchors) < 40
    got = {r.doc_id: r for r in spotsigs.op9_spotsigs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    comp = plain_groups({i: plain_spots(t, anchors) for i, t in rows})
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        mine, other, later = (plain_spots(x, anchors) for x in (t, edited, following))
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (plain_print(mine), plain_print(other))
        assert got[i].near_edited == pytest.approx(jaccard(mine, other)) and got[i].near_next == pytest.approx(jaccard(mine, later))
        assert got[i].component_id == comp[i]


def test_texts_without_anchors_are_signed_in_every_part(spark, frame):
    word = lambda i: f"слово{i}"
    base = [word(i) for i in range(90)]
    texts = {
        0: base, 1: base[:60] + [word(900 + i) for i in range(30)], 2: base[:2] + [word(500 + i) for i in range(88)],  # the last third, and all but the opening
        3: base[:2] + ["a"], 4: base[:2] + ["b", "c"],  # short texts with the same opening
        5: ["the", "house", "of", "cards"] * 20 + base[:40], 6: ["the", "house", "of", "cards"] * 20 + base[:2] + base[50:88],  # a long part without anchors
        7: ["the", *base], 8: base[:89] + ["x"],
    }
    docs = lambda ids: frame([(i, " ".join(texts[i])) for i in ids])
    got = {r.doc_id: set(r.fp) for r in spotsigs.fingerprinted(docs(texts), ANCHORS).collect()}
    assert len(got[0]) == 90
    assert jaccard(got[0], got[1]) == pytest.approx(59 / 121)
    assert jaccard(got[0], got[2]) < 0.05
    assert len(got[3]) == 3 and jaccard(got[3], got[4]) < 0.5
    assert len(got[5]) > 40 and jaccard(got[5], got[6]) < 0.1
    assert jaccard(got[0], got[7]) > 0.95 and jaccard(got[0], got[8]) > 0.95
    spots = written(spotsigs.fingerprinted(docs((0, 1, 2, 8)), ANCHORS), "spots")
    assert {r.doc_id: r.component_id for r in spotsigs.similar(spots).collect()} == {0: 0, 1: 1, 2: 2, 8: 0}


@pytest.mark.parametrize("ids", [[10**15, -7, *range(0, 40, 3), *range(10**6, 10**6 + 20)], [5], [1, 2]])
def test_next_documents(frame, ids):
    got = {r.doc_id: r.next_id for r in spotsigs.with_next_id(frame([(i, "") for i in ids]).select("doc_id")).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}


@pytest.mark.parametrize("most", [0, 30])
def test_similar_equals_brute_force(spark, frame, monkeypatch, most):
    """Whichever signatures come last."""
    rnd = random.Random(4)
    monkeypatch.setattr(spotsigs.frequent_signatures, "__defaults__", (most or 1,))
    rows, base = [], [" ".join(rnd.choice(ANCHORS) + f" w{rnd.randrange(400)}" for _ in range(50)) for _ in range(25)]
    shared = " ".join(f"the p{k}" for k in range(30))
    for n, text in enumerate(base):
        for _ in range(rnd.randrange(1, 6)):
            words = text.split()
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(1000)}"
            rows.append((len(rows), " ".join(words) + (f" {shared}" if n % 2 else "")))
    rows += [(1000, None), (1001, " ")]
    spots = written(spotsigs.fingerprinted(frame(rows), ANCHORS), "spots")
    comp = plain_groups({i: plain_spots(t) for i, t in rows})
    assert {r.doc_id: r.component_id for r in spotsigs.similar(spots).collect()} == {i: c for i, c in comp.items() if i < 1000}


def test_spots_of_nothing(spark, frame, tmp_path):
    frame([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert spotsigs.op9_spotsigs(spark, str(tmp_path)).count() == 0
    frame([(1, None), (None, "x"), (7, "a"), (7, "b")]).write.parquet(f"{tmp_path}/odd/documents.parquet")
    assert sorted(r.doc_id for r in spotsigs.op9_spotsigs(spark, f"{tmp_path}/odd").collect()) == [1, 7]
