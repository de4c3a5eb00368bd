"""The pipeline's language stage: what it rejects and what it keeps."""

import random
from collections import Counter

import pytest

from peakfield.llm import langid
from test_models import SYLLABLES, corpus


def test_unlabelled_documents_stay(frame):
    rows = [(1, "some words", None, "s"), (2, "12 !", None, "s"), (3, None, None, "s"), (4, "語", None, "s")]
    assert {r.doc_id for r in langid.identified(frame(rows)).collect()} == {1, 4}


def junk(n):
    rnd = random.Random(5)
    letters = "bcdfghjklmnpqrstvwxz"
    mash = [" ".join("".join(rnd.choices(letters, k=rnd.randrange(5, 12))) for _ in range(rnd.randrange(8, 60))) for _ in range(n)]
    return mash + ["".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=400)) for _ in range(n)] + ["字漢語文" * 30, "z" * 5000]


def likeness(text, lang, rows):
    """The share of letters that look like ``lang``, from counts of the rows that teach it."""
    words, shapes = Counter(), Counter()
    for _, t, x, _ in rows:
        if x == lang:
            words.update(langid.words_of(t))
    for w, n in words.items():
        for g in langid.grams(w, 3):
            shapes[g] += n
    found = letters = 0
    for w in langid.words_of(text):
        cut = langid.grams(w, 3)
        found += len(w) * (1 if w in words else sum(g in shapes for g in cut) / len(cut))
        letters += len(w)
    covered = 1 - sum(n == 1 for n in shapes.values()) / sum(shapes.values())
    return min(1.0, (found + 8) / (letters + 8) / covered)


def test_junk_goes_and_clean_documents_stay(frame, spark):
    rows = corpus(300)
    rnd = random.Random(6)
    unseen = [(1000 + i, " ".join("".join(rnd.choices(SYLLABLES[lang], k=5)) for _ in range(rnd.randrange(1, 30))), None, "s") for i, lang in enumerate(list(SYLLABLES) * 10)]
    noisy = [(2000 + i, f"{t} token = 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", None, "s") for i, (_, t, _, _) in enumerate(corpus(30, seed=4))]
    bad = [(3000 + i, t, lang, "s") for i, (t, lang) in enumerate(zip(junk(20), [None, *SYLLABLES] * 20, strict=False))]
    kept = {r.doc_id for r in langid.identified(frame(rows + unseen + noisy + [(*b[:2], None, "s") for b in bad])).collect()}
    assert kept == {r[0] for r in rows + unseen + noisy}
    assert {r.doc_id for r in langid.identified(frame(rows + bad), least_score=0, least_familiar=0).collect()} == {r[0] for r in rows + bad}


@pytest.mark.parametrize("remembered", [0, 10**6])
def test_likeness_by_brute_force(frame, monkeypatch, remembered):
    monkeypatch.setattr(langid, "REMEMBERED", remembered)
    rows = corpus(60)
    model = langid.Judge(*langid.learn(frame(rows)).parts)
    for text in [*junk(3), *(t for _, t, _, _ in rows[:5]), *(t[::-1] for _, t, _, _ in rows[5:10])]:
        lang, score, found = model.judge(text)
        assert (lang, score) == model.predict(text) and found == pytest.approx(likeness(text, lang, rows))
    assert model.judge(None) == model.judge("12 !") == ("und", 0.0, 0.0)


def test_little_learned_rejects_little(frame):
    """One row for each language: every trigram was met once, so nothing can be told from those that are lacking."""
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("abc", "x"), ("def", "y")] * 3)]
    model = langid.Judge(*langid.learn(frame(rows[:2])).parts)
    assert model.judge("qqq www zzz vvv")[2] == 1.0
