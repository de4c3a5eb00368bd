"""Hidden Markov language model: Baum-Welch trains latent states, the scaled forward recursion scores.

A state emits the end of a text, one of the ``OWN`` most frequent words, or one of a bounded number of
classes (a hash of the word) that share the other words out; a class emits its word by the word's
smoothed count over all training tokens. So the model has a bounded size, every count covers the
whole corpus, and no vocabulary has to fit into a task: the most frequent words, up to a bound, are
broadcast, and the counts of all others are joined to the few tokens that need them.

Each Baum-Welch round runs over all training documents; expected counts are summed over their
partitions, so that the driver sees emissions x states numbers. Rounds end once one raises the mean log
likelihood of a token by less than ``LEAST_GAIN``, however many that takes.

Words are told apart in pieces of a few MB of text, cut at white space; of a longer text only two bytes
for each token are held. Texts of any length are trained on and scored whole, in bounded memory: a text is cut into windows,
each window's transfer matrix (states x states) is found for all windows side by side, a chain over
these matrices gives what enters each window from both ends, and then the recursions run inside the
windows. This equals the recursions over the whole text.

Nulls: a null text is an empty one and has just the end token. Rows without a doc_id are left out;
of rows that share a doc_id the one with the greatest text counts. Words of equal frequency are
ranked by their hash. Extra columns are not read. An empty table gives an empty result; without
training rows the model is uniform and the base score 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfield.llm.common import SPACES, bounded_batches, crc_of_id, documents, named, one_row_per_id, written

#: States; words that a state emits directly; classes by hash for all other words. Emission 0 is the end of a text, then come the classes, then the words.
STATES, OWN, HASHED = 8, 12_287, 4096
#: Tokens in a window, and windows side by side.
WINDOW, WIDE = 256, 1024
#: Words whose counts are broadcast, at most.
HEAD = 500_000
#: Bytes of text whose words are told apart at a time; a longer word is not cut.
PIECE = 8 << 20
#: Rounds end when one gains less than this for a token, in log10.
LEAST_GAIN = 0.01


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def hashed_class(h: np.ndarray) -> np.ndarray:
    """The class of words, by their hashes, that are none of the model's own."""
    return 1 + h % HASHED


IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))


def cut_text(text: pa.Array) -> Iterator[pa.Array]:
    """One text, in pieces of about ``PIECE`` bytes that end with white space, so that every word is whole in one of them."""
    data, at = np.frombuffer(text[0].as_buffer(), np.uint8), 0
    while at < len(data):
        end = at + PIECE
        before = np.flatnonzero(IS_SPACE[data[at:end]])
        if end < len(data) and len(before):
            end = at + before[-1] + 1
        while end < len(data) and not len(before):
            before = np.flatnonzero(IS_SPACE[data[end : end + PIECE]])
            end += before[0] + 1 if len(before) else PIECE
        yield pa.array([data[at:end].tobytes()], pa.binary()).cast(pa.string())
        at = end


def pieces_of(text: pa.Array) -> Iterator[tuple[int, int, Iterable[pa.Array]]]:
    """A batch of texts in (first row, row after the last, pieces): rows of ``PIECE`` bytes together at most are one piece, a longer text has several."""
    n = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, i = np.cumsum(n), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + PIECE, side="right")))
        rows = text.slice(i, j - i)
        yield i, j, cut_text(rows) if n[i] > PIECE else [rows]
        i = j


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: the hashes of its distinct words, for each word which of them it is, and the text it stands in."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat, n = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    at = np.repeat(np.arange(len(n)), n)[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    return np.fromiter(map(word_hash, distinct), np.int64, len(distinct)), coded.indices.to_numpy(), at


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        h, back = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for x, _ in held)]), return_inverse=True)
        n = np.bincount(back, np.concatenate([np.zeros(0), *(n for _, n in held)]), len(h)).astype(np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["h", "n"])

    for batch in batches:
        for piece in (p for _, _, pieces in pieces_of(batch.column("text")) for p in pieces):
            h, words, _ = words_of(piece)
            held.append((h, np.bincount(words, minlength=len(h))))
            if sum(len(x) for x, _ in held) > 1_000_000:
                yield out()
    yield out()


def vocabulary(train: DataFrame) -> DataFrame:
    """(h, n): every word of the training texts, as a 64-bit hash, and how often it occurs."""
    return train.select("text").mapInArrow(_word_counter, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def head(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, sorted, and counts of the words over the least frequency that ``most`` words at most exceed."""
    step = F.floor(F.log2("n") * 16).cast("long")
    by_step = sorted(((r["step"], r["k"]) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()), reverse=True)  # 1024 rows at most
    total, least = 0, None
    for s, k in by_step:
        if total + k > most:
            break
        total, least = total + k, s
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = words.where(step >= least).toPandas()
    order = np.argsort(table["h"].to_numpy())
    return table["h"].to_numpy()[order], table["n"].to_numpy()[order]


def own_words(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """For each word of the head its emission if it has one of its own, as the ``most`` most frequent have, or 0."""
    own = np.zeros(len(keys), np.int64)
    best = np.lexsort((keys, -counts))[:most]
    own[best] = 1 + HASHED + np.arange(len(best))
    return own


def _tokeniser(frequent) -> Callable:
    """For each text its classes, the log10(c + 1) of its frequent words, and the other words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, own = frequent.value
        logs = np.log10(np.append(counts, 0) + 1.0)

        def of_rows(batch: pa.RecordBatch, pieces: Iterable[pa.Array]) -> pa.RecordBatch:
            rows = batch.num_rows
            n, known, sums, listed = (np.zeros(rows, t) for t in (np.int64, np.int64, np.float64, np.int64))
            classes, rare, often = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for piece in pieces:
                h, words, at = words_of(piece)
                place = np.searchsorted(keys, h)
                place[(place == len(keys)) | (np.append(keys, 0)[place] != h)] = len(keys)
                has = place < len(keys)
                mine = np.append(own, 0)[place]
                classes.append(np.where(mine > 0, mine, hashed_class(h)).astype("<u2")[words])
                n += np.bincount(at, minlength=rows)
                known += np.bincount(at, has[words], rows).astype(np.int64)
                sums += np.bincount(at, logs[place][words], rows)
                # the other words: each once for a text (or a piece of one), with how often it stands there
                other = ~has[words]
                pairs, times = np.unique(at[other] * len(h) + words[other], return_counts=True)
                listed += np.bincount(pairs // max(1, len(h)), minlength=rows)
                rare.append(h[pairs % max(1, len(h))])
                often.append(times)
            ends = np.cumsum(n + 1)
            flat, word = np.zeros(ends[-1], "<u2"), np.ones(ends[-1], bool)
            word[ends - 1] = False
            flat[word] = np.concatenate(classes)
            tokens = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(flat)])
            offsets = pa.array(np.append(0, np.cumsum(listed)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (rare, often)]
            added = [tokens, pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), *lists]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *added], ["doc_id", "held_out", "classes", "n_tokens", "n_known", "logs", "rare", "times"])

        for batch in batches:
            for first, last, pieces in pieces_of(batch.column("text")):
                yield of_rows(batch.slice(first, last - first), pieces)

    return run


class Windows:
    """Sequences of classes, one after the other in ``flat``, cut into windows of ``size`` tokens at most."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, size: int):
        per_seq = -(-lengths // size)
        self.flat, self.size = flat, size
        self.seq = np.repeat(np.arange(len(lengths)), per_seq)
        self.k = np.arange(len(self.seq)) - np.repeat(np.cumsum(per_seq) - per_seq, per_seq)
        self.last = self.k == per_seq[self.seq] - 1
        self.start = np.repeat(np.cumsum(lengths) - lengths, per_seq) + self.k * size
        self.length = np.where(self.last, lengths[self.seq] - self.k * size, size)

    def side_by_side(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the windows ``which`` some at a time, the longest first: (windows, tokens by time, how many last beyond each time)."""
        which = which[np.argsort(-self.length[which], kind="stable")]
        for i in range(0, len(which), WIDE):
            some = which[i : i + WIDE]
            n = self.length[some]
            t = np.arange(n[0])
            tokens = self.flat[np.minimum(self.start[some] + t[:, None], len(self.flat) - 1)]
            yield some, tokens, len(n) - np.searchsorted(n[::-1], t, side="right")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def entering(w: Windows, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: the states before its first token, those at the last token before it, and what follows its last token.

    The first two are distributions, the third is beta up to a factor.
    """
    states = len(start)
    prior, before, after = np.tile(start, (len(w.seq), 1)), np.zeros((len(w.seq), states), start.dtype), np.ones((len(w.seq), states), start.dtype)
    several = np.flatnonzero((w.k > 0) | ~w.last)
    if not len(several):
        return prior, before, after
    transfer = np.empty((len(w.seq), states, states), start.dtype)
    for some, tokens, active in w.side_by_side(several):
        x = np.zeros((len(some), states, states), start.dtype)
        x[:, np.arange(states), np.arange(states)] = emit[tokens[0]]
        for t in range(1, len(tokens)):
            a = active[t]
            x[:a] = (x[:a].reshape(-1, states) @ move).reshape(-1, states, states) * emit[tokens[t, :a]][:, None]
            if t % 4 == 0:
                x[:a] /= x[:a].max(axis=(1, 2), keepdims=True)
        transfer[some] = x / x.max(axis=(1, 2), keepdims=True)
    by_k = several[np.argsort(w.k[several], kind="stable")]
    parts = np.split(by_k, np.flatnonzero(np.diff(w.k[by_k])) + 1)
    for at in parts[1:]:  # from the first window of each text on
        before[at] = _unit(np.einsum("ni,nij->nj", prior[at - 1], transfer[at - 1]))
        prior[at] = before[at] @ move
    for at in reversed(parts[1:]):
        after[at - 1] = _unit(np.einsum("nij,nj->ni", transfer[at], after[at])) @ move.T
    return prior, before, after


def forward(tokens: np.ndarray, active: np.ndarray, prior: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Scaled forward recursion inside windows: the scales by time (1 beyond a window's end), the alphas in ``keep``."""
    scale = np.ones(tokens.shape, prior.dtype)
    a = prior
    for t, k in enumerate(active):
        a = (a if t == 0 else a[:k] @ move) * emit[tokens[t, :k]]
        s = a.sum(axis=1)
        a /= s[:, None]
        scale[t, :k] = s
        if keep is not None:
            keep[t, :k] = a
    return scale


def expected_in(w: Windows, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of first states, moves and emissions, and the log likelihood (natural)."""
    states = len(start)
    prior, before, after = entering(w, start, move, emit)
    first, moves, emitted, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((len(emit), states)), 0.0
    for some, tokens, active in w.side_by_side(np.arange(len(w.seq))):
        alphas = np.empty((*tokens.shape, states), start.dtype)
        likelihood += float(np.log(forward(tokens, active, prior[some], move, emit, alphas), dtype=np.float64).sum())
        beta, k2 = after[some], 0
        for t in range(len(tokens) - 1, -1, -1):
            k = active[t]
            if k2:
                ahead = emit[tokens[t + 1, :k2]] * beta[:k2]
                beta[:k2] = ahead @ move.T
            gamma = alphas[t, :k] * beta[:k]
            norm = gamma.sum(axis=1, keepdims=True)
            if k2:
                moves += (alphas[t, :k2] / norm[:k2]).T @ ahead
            alphas[t, :k] = gamma / norm
            beta[:k] /= norm
            k2 = k
        later = np.flatnonzero(w.k[some] > 0)
        ahead = emit[tokens[0, later]] * beta[later]
        moves += (before[some[later]] / (prior[some[later]] * ahead).sum(axis=1, keepdims=True)).T @ ahead
        first += alphas[0, w.k[some] == 0].sum(axis=0)
        inside = np.arange(len(some)) < active[:, None]
        seen = tokens[inside]
        for s in range(states):
            emitted[:, s] += np.bincount(seen, alphas[..., s][inside], len(emit))
    return first, moves * move, emitted, likelihood


def expected(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    return expected_in(Windows(np.concatenate(seqs).astype(np.int64), np.array(list(map(len, seqs))), window), start, move, emit)


def log_scales(w: Windows, start: np.ndarray, move: np.ndarray, emit: np.ndarray, per_class: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` sequences its log10 probability, plus ``per_class`` of its tokens."""
    prior, _, _ = entering(w, start, move, emit)
    out = np.zeros(n)
    for some, tokens, active in w.side_by_side(np.arange(len(w.seq))):
        inside = np.arange(len(some)) < active[:, None]
        each = np.log10(forward(tokens, active, prior[some], move, emit)) + np.where(inside, per_class[tokens], 0.0)
        out += np.bincount(w.seq[some], each.sum(axis=0), n)
    return out


def _windows(classes: pa.Array, size: int = WINDOW) -> Windows:
    offsets = np.frombuffer(classes.buffers()[1], np.int32)[classes.offset : classes.offset + len(classes) + 1]
    flat = np.frombuffer(classes.buffers()[2], "<u2", (offsets[-1] - offsets[0]) // 2, offsets[0]) if offsets[-1] > offsets[0] else np.zeros(1, "<u2")
    return Windows(flat, np.diff(offsets) // 2, size)


def _expecter(model) -> Callable:
    """(at, n0, n1, ...): sums over a partition, a column for each state. at: a class, beyond the classes the next state, then the first, then the likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = (x.astype(np.float32) for x in model.value)
        states = len(start)
        total = np.zeros((len(emit) + states + 2, states))
        for batch in batches:
            if batch.num_rows:
                first, moves, emitted, likelihood = expected_in(_windows(batch.column("classes")), start, move, emit)
                total += np.concatenate([emitted, moves.T, first[None], np.full((1, states), likelihood)])
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, s]) for s in range(states))], ["at", *(f"n{s}" for s in range(states))])

    return run


def maximised(total: np.ndarray, mass: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model for expected counts. Each class's mass is shared out by the states that its tokens came from.

    ``mass`` is a class's smoothed count, as in the base score. A class's shares are drawn towards
    the states' overall shares, the more so the rarer it is; together the states so keep the base
    score's distribution over words, which they refine only where counts tell them to.
    """
    classes = len(mass)
    emitted, moves, first = total[:classes], total[classes : classes + states].T, total[classes + states]
    overall = (emitted.sum(axis=0) + 1) / (emitted.sum() + states)
    shares = (emitted + overall) / (emitted.sum(axis=1, keepdims=True) + 1)
    emit = shares * mass[:, None]
    return (first + 0.1) / (first + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0)


def round_of(train: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, float]:
    """Expected counts under ``model`` summed over the partitions of ``train``, and the log likelihood."""
    spark, states = train.sparkSession, len(model[0])
    shared = spark.sparkContext.broadcast(model)
    kinds = ", ".join(["at int", *(f"n{s} double" for s in range(states))])
    sums = train.select("classes").mapInArrow(_expecter(shared), kinds).groupBy("at").agg(*(F.sum(f"n{s}").alias(f"n{s}") for s in range(states))).toPandas()  # classes + states + 2 rows at most
    total = np.zeros((len(model[2]) + states + 2, states))
    total[sums["at"].to_numpy()] = sums[[f"n{s}" for s in range(states)]].to_numpy()
    shared.unpersist()
    return total, float(total[-1, 0])


def first_model(mass: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A seeded start: states that emit by the masses times chance, and stay with nine parts in ten."""
    emit = mass[:, None] * (np.random.default_rng(42).gamma(0.5, size=(len(mass), states)) + 0.05)
    return np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0)


def trained(train: DataFrame, mass: np.ndarray, n_tokens: int, states: int = STATES, least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch over all of ``train``, until a round raises a token's mean log10 likelihood by less than ``least_gain``."""
    model, reached = first_model(mass, states), -np.inf
    while n_tokens:
        total, likelihood = round_of(train, model)
        model = maximised(total, mass, states)
        mean = likelihood / np.log(10) / n_tokens
        if mean - reached < least_gain:
            break
        reached = mean
    return model


def _scorer(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, mass = model.value
        for batch in batches:
            score = log_scales(_windows(batch.column("classes")), start, move, emit, -np.log10(mass), batch.num_rows)
            kept = ["doc_id", "held_out", "n_tokens", "n_known", "logs"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], [*kept, "model"])

    return run


def masses(words: DataFrame, keys: np.ndarray, counts: np.ndarray, own: np.ndarray, n_train: int) -> tuple[np.ndarray, int, int]:
    """The smoothed count of each emission, the training tokens and the distinct ones.

    It is one for each token and distinct word, and for a hash class one for words never seen. The end counts once for
    each training text.
    """
    by_class = words.groupBy(F.pmod("h", F.lit(HASHED)).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()  # HASHED rows at most
    mine = own > 0
    mass = np.ones(1 + HASHED + int(mine.sum()))
    mass[1 + by_class["c"].to_numpy(int)] += by_class["n"].to_numpy() + by_class["v"].to_numpy()
    np.subtract.at(mass, hashed_class(keys[mine]), counts[mine] + 1)
    mass[own[mine]] = counts[mine] + 1
    mass[0] = n_train + 1
    return mass, int(by_class["n"].sum()) + n_train, int(by_class["v"].sum()) + (n_train > 0)


def scored(docs: DataFrame, held_out, states: int = STATES, most: int = HEAD, own_most: int = OWN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), log10.

    ``held_out``: a condition; rows that meet it are scored but not learned from.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = named(one_row_per_id(docs)).select("doc_id", "text", held_out.alias("held_out"))
    words = written(vocabulary(texts.where("NOT held_out")), "words")
    keys, counts = head(words, most)
    own = own_words(keys, counts, own_most)
    frequent = spark.sparkContext.broadcast((keys, counts, own))
    rows = written(texts.mapInArrow(_tokeniser(frequent), "doc_id long, held_out boolean, classes binary, n_tokens long, n_known long, logs double, rare array<long>, times array<long>"), "tokens")
    train = rows.where("NOT held_out")
    n_train = train.count()
    mass, n, v = masses(words, keys, counts, own, n_train)
    model = spark.sparkContext.broadcast((*trained(train, mass, n, states), mass))
    rare = rows.select("doc_id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("doc_id", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    found = rare.join(words, "h").groupBy("doc_id").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    likelihood = rows.select("doc_id", "held_out", "classes", "n_tokens", "n_known", "logs").mapInArrow(_scorer(model), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double")
    joined = likelihood.join(found, "doc_id", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + float(np.log10(n_train + 1))
    known = F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(n_train > 0)
    return joined.select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), (F.col("model") + logs).alias("score"),
    )


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), F.pmod(crc_of_id(), F.lit(7)) == 2)
