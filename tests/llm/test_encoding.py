"""Token ids, files of them, counts and packing against the untouched tokenizers library."""

import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from peakfield.llm import arrowfile, lengths, packing
from peakfield.llm.common import scratch_path, written
from peakfield.llm.encoding import KEEPS_SPACES, encoder, pattern_of

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@cache
def plain(path):
    whole = Tokenizer.from_file(path)
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_odd_texts_encode_as_the_library_does(path, odd_rows):
    want = plain(path)
    for _, text in [*odd_rows, (0, "<|endoftext|> x"), (0, "a　 b"), (0, "Σας ΣΑΣ")]:
        assert np.frombuffer(encoder(path).ids(text or ""), "<u4").tolist() == want(text), text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z'.,\n\t\r1é́ 語<|>²\x1c\x85ß")), max_size=30))
def test_any_text_encodes_as_the_library_does(text):
    for path in (BYTES, WORDS):
        assert np.frombuffer(encoder(path).ids(text), "<u4").tolist() == plain(path)(text)


PARTS = ["the", "The", "cat", "Hi", "So", "dog", " ", "  ", "\n", "\n\n", " \n", "\n ", ". ", ".\n", ",", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "é", "e\u0301", "語", "\t", "\r", "\x1c", "\x85", "\xa0", "1", "42", "²", "ß", "İ", "Σας", "!", "#", "\u3000", "ǅ", "µ"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_what_a_worker_met_before_changes_nothing(path):
    """One encoder for all texts, in any order: blanks before line ends, and strings of added tokens, among them."""
    rnd, shared, want = random.Random(7), encoder(path), plain(path)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randrange(1, 14))) for _ in range(6000)]
    texts += ["Hi So\nThe cat", "The end. \n\nThe dog ran", "one. two\n.", "one \n. two", "end of page <|endoftext|> next"]
    for _ in range(2):
        rnd.shuffle(texts)
        for text in texts:
            assert np.frombuffer(shared.ids(text), "<u4").tolist() == want(text), text


def test_other_vocabularies_go_through_the_library():
    steps = {"normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "added_tokens": []}
    assert pattern_of(steps) == (None, False)
    assert pattern_of({"normalizer": {"type": "NFC"}, "pre_tokenizer": KEEPS_SPACES}) == (None, False)


def test_files_round_trip(spark, frame, odd_rows):
    want, encode, at, stream = [], plain(BYTES), 0, []
    for i, text in sorted(odd_rows):
        ids = np.array([*encode(text), 2], "<u4")
        stream += ids.tolist()
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    folder = scratch_path(spark, "files")
    manifest = arrowfile.write_files(frame(odd_rows), folder, BYTES, 2, length=64, bytes_per_file=20_000)
    assert manifest.count() > 2
    assert sorted(map(tuple, arrowfile.read_files(manifest, folder).collect())) == want
    first = manifest.orderBy("start").first()
    ids, mask = arrowfile.sequence(folder, first["file"], 0)
    assert len(ids) == len(mask) == 64 and pc.all(mask).as_py()
    # neither was copied: both are parts of one mapped buffer
    data = mask.buffers()[1]
    assert not ids.flags.owndata and data.parent is not None and abs(ids.__array_interface__["data"][0] - data.address) < 1 << 20
    assert ids.tolist() == stream[:64]
    last_ids, last_mask = arrowfile.sequence(folder, first["file"], -(-first["n_tokens"] // 64) - 1)
    assert pc.sum(last_mask).as_py() == (first["n_tokens"] - 1) % 64 + 1


def test_histogram_and_suffix_sums(spark, frame, odd_rows, monkeypatch):
    monkeypatch.setattr(lengths, "BUCKET", 16)
    encode = plain(BYTES)
    sizes = [len(encode(t)) for _, t in odd_rows]
    hist = written(lengths.histogram(frame(odd_rows), BYTES), "hist")
    got = {r.context_limit: r for r in lengths.limits(hist).collect()}
    assert set(got) == set(sizes)
    for c, r in got.items():
        kept = sum(min(n, c) for n in sizes)
        assert (r.n_docs, r.docs_over, r.tokens_over) == (sizes.count(c), sum(n > c for n in sizes), sum(n for n in sizes if n > c))
        assert (r.tokens_total, r.tokens_kept, r.tokens_lost, r.docs_within) == (sum(sizes), kept, sum(sizes) - kept, sum(n <= c for n in sizes))
    contexts = spark.createDataFrame([(c,) for c in (0, 1, 7, 100, 10**6)], "context_limit long")
    assert {r.context_limit: r.tokens_kept for r in lengths.truncated_totals(hist, contexts).collect()} == {c: sum(min(n, c) for n in sizes) for c in (0, 1, 7, 100, 10**6)}
    odd = spark.createDataFrame([(7,), (7,), (None,)], "context_limit long")
    assert lengths.truncated_totals(hist, odd).count() == 1
    assert lengths.quantile(lengths.limits(hist), 0.5).first()[0] == sorted(sizes)[(len(sizes) + 1) // 2 - 1]


def test_token_counts_query(spark, frame, odd_rows, tmp_path):
    frame(odd_rows).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = sorted(len(plain(BYTES)(t)) for _, t in odd_rows)
    got = lengths.op3_token_counts(spark, str(tmp_path)).collect()
    assert {r.context_limit for r in got if r.kind == "length"} == set(sizes)
    assert [r.context_limit for r in sorted(got) if r.kind == "context"] == list(lengths.CONTEXTS)
    for r in got:
        assert r.n_docs == sizes.count(r.context_limit) and r.tokens_kept == sum(min(n, r.context_limit) for n in sizes)
    assert {r.share: r.context_limit for r in got if r.kind == "quantile"} == {x: next(n for k, n in enumerate(sizes) if (k + 1) / len(sizes) >= x and sizes[min(k + 1, len(sizes) - 1)] != n or k == len(sizes) - 1) for x in lengths.SHARES}


def test_packing(frame, odd_rows):
    encode, size, want = plain(WORDS), 64, []
    for i, text in odd_rows:
        ids = np.array([*encode(text), 0], "<u4")
        want += [(i, k, a, len(ids[a : a + size]), zlib.crc32(ids[a : a + size].tobytes())) for k, a in enumerate(range(0, len(ids), size))]
    got = [tuple(r) for r in packing.pack_documents(frame(odd_rows), WORDS, 0, size).collect()]
    assert sorted(r[:5] for r in got) == sorted(want)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r[5]].append((r[6], r[3]))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    counts = np.bincount([r[3] for r in want], minlength=size + 1)
    assert len(by_sequence) <= sum(times for _, times in packing.best_fit(counts, size)) + 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 128), max_size=300))
def test_plans_use_up_the_histogram(sizes):
    counts = np.bincount(sizes, minlength=129) if sizes else np.zeros(129, int)
    used = np.zeros(129, int)
    for pattern, times in packing.plan(counts, 128):
        assert sum(pattern) <= 128 and times > 0
        for v in pattern:
            used[v] += times
    assert (used == counts).all()


def test_patterns_take_the_bulk():
    counts = np.zeros(2049, int)
    counts[[500, 548, 1000, 1048, 1500, 2048]] = 10_000
    packed = packing.plan(counts, 2048)
    assert sum(t for _, t in packed) <= -(-int(counts @ np.arange(2049)) // 2048) * 1.01
    x = packing.fit(packing.candidate_patterns(counts, 2048), counts)
    many = np.bincount(np.random.default_rng(0).gamma(1.2, 300, 200_000).astype(int).clip(1, 2048), minlength=2049) * 1000
    patterns = packing.candidate_patterns(many, 2048)
    fitted = packing.fit(patterns, many)
    left = many - sum(np.bincount(p, fitted, minlength=2049) for p in patterns.T)
    left[0] = 0
    step = np.maximum(left[patterns].sum(axis=1) / (patterns > 0).sum(axis=1), -fitted)
    assert fitted.min() >= 0 and np.sum(step**2) < 0.01 * (many @ many)  # nothing that a step could still gain
    chosen = packing.disjoint(patterns, many[patterns].sum(axis=1).astype(float))
    assert np.bincount(patterns[chosen].ravel(), minlength=2049)[1:].max() <= 2
    assert x.min() >= 0 and x.sum() > 20_000


def test_empty_tables(spark, frame):
    folder = scratch_path(spark, "files")
    assert arrowfile.read_files(arrowfile.write_files(frame([]), folder, BYTES, 2), folder).count() == 0
    assert packing.pack_documents(frame([]), WORDS, 0).count() == 0
    assert lengths.limits(lengths.histogram(frame([]), BYTES)).count() == 0


def test_repeated_rows_and_null_ids(spark, frame):
    docs = frame([(5, "b"), (5, "a b c"), (None, "x"), (5, "b")]).selectExpr("*", "1 AS piece", "2 AS length", "3 AS file", "4 AS bucket")
    folder = scratch_path(spark, "files")
    got = arrowfile.read_files(arrowfile.write_files(docs, folder, BYTES, 2), folder).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(5, 0, 4), (5, 4, 2), (5, 6, 2)]
    assert packing.pack_documents(docs, WORDS, 0).count() == 3
