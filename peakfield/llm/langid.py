"""Language identification by words first, backing off to shorter and shorter character n-grams.

A word of the model counts with its log frequency in each language. A word that the model lacks is
cut into n-grams, padded at both ends, from the longest n down to single characters; the first n of
which the model has any gram decides, with the mean log frequency of those grams. The sum over the
whole text, with the languages' shares as prior, gives the language and its posterior.

The model is fitted on a bounded sample of labelled rows: about ``rows_per_lang`` of each language,
chosen by a hash of the doc_id. Every word and n-gram of these rows is in it. Every row is predicted,
from its whole text, of any length, and nothing else. A worker remembers what words add to the sum, up to
a number of words, which changes no result.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with a null lang are not
learned from; rows without a doc_id are left out. Repeated rows are each predicted. Without a
labelled row every text is ``und``. Ties go to the language that comes first in code-point order.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfield.llm.common import apart, bounded_batches, crc_of_id, documents, named, one_row_per_id, written

UNKNOWN = "und"
#: A word is a run of letters and the marks on them; digits, signs and punctuation part words.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST = 5
#: Words that a worker remembers.
REMEMBERED = 200_000
#: The posterior that a language needs for a document to be taken as written in it, and the share of the text's letters that has to look like it.
LEAST_SCORE = 0.5
LEAST_FAMILIAR = 0.3
#: The n-grams by which a word that a language lacks looks like it or not, and the letters that each text is granted, as a short one tells little.
SHAPE = 3
GRANTED = 8


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, gram, n): kind 0 are words, 1 to LONGEST n-grams; sums of a part of the rows."""
    by_lang: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = []
        for lang, words in by_lang.items():
            counts: dict[tuple[int, str], int] = Counter()
            for word, n in words.items():
                counts[0, word] += n
                for k in range(1, LONGEST + 1):
                    for g in grams(word, k):
                        counts[k, g] += n
            rows += [(lang, k, g, n) for (k, g), n in counts.items()]
        by_lang.clear()
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, by_lang.values())) > 100_000:
            yield out()
    yield out()


class Model:
    """langs, the log priors, and log frequencies by language of words and of grams."""

    def __init__(self, langs: list[str], priors: np.ndarray, entries: pa.Table, shape: dict[tuple[str, int], tuple[int, int]]):
        """entries: (kind, gram, by_lang: counts in the order of langs); shape: for (lang, kind) how many tokens and different entries there are."""
        self.langs, self.priors, self.at, self.logs, self.seen = langs, priors, [], [], []
        kinds, grams_, counts = entries["kind"].to_numpy(), entries["gram"].combine_chunks(), entries["by_lang"].combine_chunks().flatten().to_numpy().reshape(len(entries), len(langs))
        for kind in range(LONGEST + 1):
            rows = np.flatnonzero(kinds == kind)
            self.at.append(dict(zip(grams_.take(pa.array(rows)).to_pylist(), range(len(rows)), strict=True)))
            total, different = (np.array([shape.get((lang, kind), (0, 0))[k] for lang in langs], float) for k in range(2))
            self.logs.append(np.log((counts[rows] + 0.5) / (total + 0.5 * different + 1)))
            self.seen.append(counts[rows] > 0 if kind in (0, SHAPE) else None)
            if kind == SHAPE:  # the share of new text's n-grams that a language has, by Good and Turing: all but what was met once
                self.covered = 1 - (counts[rows] == 1).sum(axis=0) / np.maximum(total, 1)
        self.known: dict[str, int] = {}
        self.parts = np.empty((1024, self._width()))

    def _width(self) -> int:
        return len(self.langs)

    def part(self, word: str) -> np.ndarray:
        """What ``word`` adds for each language: nothing if the model has none of its characters."""
        i = self.at[0].get(word)
        if i is not None:
            return self.logs[0][i]
        for k in range(LONGEST, 0, -1):
            have = self.at[k]
            found = [have[g] for g in grams(word, k) if g in have]
            if found:
                return self.logs[k][found].mean(axis=0)
        return np.zeros(len(self.langs))

    def _row(self, word: str) -> np.ndarray:
        """What is added up over a text's words; languages first."""
        return self.part(word)

    def _remembered(self, word: str) -> int | None:
        n = len(self.known)
        if n == REMEMBERED:
            return None
        if n == len(self.parts):
            self.parts = np.concatenate([self.parts, np.empty_like(self.parts)])
        self.parts[n] = self._row(word)
        self.known[word] = n
        return n

    def _sums(self, text: str | None) -> np.ndarray | None:
        words = words_of(text or "")
        if not words or not self.langs:
            return None
        at = list(map(self.known.get, words))
        beyond = []
        if None in at:
            for i, x in enumerate(at):
                if x is None:
                    at[i] = x = self.known[words[i]] if words[i] in self.known else self._remembered(words[i])
                    if x is None:
                        beyond.append(i)
                        at[i] = 0
        parts = self.parts[at]
        for i in beyond:
            parts[i] = self._row(words[i])
        return parts.sum(axis=0)

    def _told(self, sums: np.ndarray) -> tuple[int, float]:
        total = self.priors + sums[: len(self.langs)]
        best = int(np.argmax(total))
        return best, float(1 / np.exp(total - total[best]).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        sums = self._sums(text)
        if sums is None:
            return UNKNOWN, 0.0
        best, score = self._told(sums)
        return self.langs[best], score

    def judge(self, text: str | None) -> tuple[str, float, float | None]:
        return *self.predict(text), None


class Judge(Model):
    """A model that also tells how much of a text looks like its language, which takes more time for each new word."""

    def _width(self) -> int:
        return 2 * len(self.langs) + 1

    def familiar(self, word: str) -> np.ndarray:
        """How much of ``word`` looks like each language: all of a word that the language has, else the share of its n-grams that it has."""
        i, have = self.at[0].get(word), self.at[SHAPE]
        if i is not None and self.seen[0][i].all():
            return np.ones(len(self.langs))
        cut = grams(word, SHAPE)
        of = self.seen[SHAPE][[have[g] for g in cut if g in have]].sum(axis=0) / len(cut)
        return of if i is None else np.where(self.seen[0][i], 1.0, of)

    def _row(self, word: str) -> np.ndarray:
        """``part``, the familiar letters by language, and the letters."""
        return np.concatenate([self.part(word), len(word) * self.familiar(word), [len(word)]])

    def judge(self, text: str | None) -> tuple[str, float, float | None]:
        """The language, its posterior, and the share of the text's letters that look like it, measured by what clean text would reach: 1 at most."""
        sums = self._sums(text)
        if sums is None:
            return UNKNOWN, 0.0, 0.0
        best, score = self._told(sums)
        share = (sums[len(self.langs) + best] + GRANTED) / (sums[-1] + GRANTED)
        return self.langs[best], score, float(share / self.covered[best]) if share < self.covered[best] else 1.0


class Learned:
    """What a ``Model`` is made of, as Arrow columns; sent to a worker, it arrives as the model, or as what ``made`` says."""

    made = Model

    def __init__(self, *parts):
        self.parts = parts

    def __reduce__(self):
        return self.made, self.parts


def learn(docs: DataFrame, rows_per_lang: int = 1000) -> Learned:
    """docs: labelled rows (doc_id, text, lang). What comes to the driver is what ``rows_per_lang`` rows of each language hold."""
    bounded_batches(docs.sparkSession)
    rows = named(docs, "lang").where("lang IS NOT NULL")
    per_lang = rows.groupBy("lang").agg(F.count("*").alias("_rows"))
    langs = {r["lang"]: r["_rows"] for r in per_lang.collect()}  # a row for each label
    order = sorted(langs, key=lambda x: x.encode())
    luck = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.join(F.broadcast(per_lang), "lang").where(luck * F.col("_rows") < rows_per_lang)
    counts = sample.select("lang", "text").mapInArrow(_counter, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    shape = {(r["lang"], r["kind"]): (r["t"], r["k"]) for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("t"), F.count("*").alias("k")).collect()}
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in order]
    entries = counts.groupBy("kind", "gram").agg(F.array(*by_lang).cast("array<long>").alias("by_lang")).toArrow()
    priors = np.log(np.array([langs[x] for x in order], float) / max(1, sum(langs.values())))
    return Learned(order, priors, entries, shape)


def _predictor(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [m.judge(t) for t in texts]
            lettered = pa.array([bool(LETTERS.search(t)) for t in texts] if not m.langs else [x[0] != UNKNOWN for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64()), lettered], ["doc_id", "held_out", "lang_pred", "score", "familiar", "lettered"])

    return run


def _predictions(docs: DataFrame, made: type[Model] = Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, familiar, lettered); familiar, null but for a ``Judge``: the share of the letters that look like the language; lettered: the text has a letter, whether or not a language was learned."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held_out = F.pmod(crc_of_id(), F.lit(3)) == 1
    learned = learn(docs.where("doc_id IS NOT NULL").where(~held_out))
    learned.made = made
    model = spark.sparkContext.broadcast(learned)
    return named(docs).select("doc_id", "text", held_out.alias("held_out")).mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double, familiar double, lettered boolean")


def predicted(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the labelled rows that are not held out."""
    return _predictions(docs).drop("familiar", "lettered")


def identified(docs: DataFrame, least_score: float = LEAST_SCORE, least_familiar: float = LEAST_FAMILIAR) -> DataFrame:
    """``docs`` in a language that the model knows, with ``lang`` filled in where it is null.

    Rejected are texts without a letter, those for which no language reaches ``least_score``, and those that look like none: where less than
    ``least_familiar`` of the letters are in words of the best language or in its trigrams. That share is measured by what new text of
    the language would reach, told by the trigrams met once, so a language of which little was learned rejects little. A row without a label
    gets the predicted one; labels that are there stay. Where no language was learned nothing can be told, so texts
    with a letter stay as they are. Of rows that share a doc_id the one with the greatest text stands for it; rows
    without a doc_id go. An empty table stays empty, and columns stay as they are, whatever their names.
    """
    docs = one_row_per_id(docs)
    told = _predictions(docs, Judge).where(F.col("lettered") & (((F.col("score") >= least_score) & (F.col("familiar") >= least_familiar)) | (F.col("lang_pred") == UNKNOWN)))
    told = told.select(F.col("doc_id").alias("_told_id"), F.col("lang_pred").alias("_told"))
    kept = apart(docs).join(told, F.col("_row.doc_id").cast("long") == F.col("_told_id"))
    lang = F.coalesce(F.col("_row.lang"), F.nullif("_told", F.lit(UNKNOWN)))
    return kept.select(*((lang if c == "lang" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op8_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(documents(spark, sf_dir))
