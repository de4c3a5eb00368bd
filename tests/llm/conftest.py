import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows):
        rows = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, white space, long texts, ties, copies, other scripts; every doc_id once."""
    rnd = random.Random(3)
    words = "the of apple banana cherry and to date elder fig le de grape Haus und ÉTÉ naïve it's 42 x1 a,b (c) 語 word-word".split()
    texts = [None, "", " ", "\n\t \r", "one", "one", " one\n", "a  b", "a \n b", "x\n\ny", "tail ", " head", "tab\tbed", "nb sp", "\x1c\x85", "don't we'll", "0123 4567", "!!! ...", "é́ é"]
    texts += [" ".join(rnd.choices(words, k=rnd.choice([3, 20, 200]))) for _ in range(60)]
    texts += [" ".join(rnd.choices(words, k=9000)), texts[-1], texts[-2] + "\n"]
    ids = rnd.sample(range(-50, 5000), len(texts))
    return list(zip(ids, texts, strict=True))
