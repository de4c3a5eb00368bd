"""Exact deduplication by composable polynomial fingerprints.

Texts are equal when they are identical without their ASCII white space. A text's bytes b_0 .. b_n-1
have the fingerprint sum of (b_i + 1) * x^(n-1-i), modulo two primes, next to n. Of two chunks in a
row it is first * x^(length of the second) + second, so the chunks of a huge document are hashed in
parallel, as rows of their own, and combined. Documents with equal fingerprints are then compared
with one of their group, chunk by chunk, so a collision never merges different texts.

Nulls: a null text is an empty one, and all texts without a character but white space are equal.
Rows without a doc_id are left out; of rows that share a doc_id the one with the greatest text stands
for it. Of equal texts the one with the most code points stays, then the smallest doc_id. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfield.llm.common import SPACES, bounded_batches, documents, join_groups, named, one_row_per_id, written

#: Two primes below 2^31, and a base: powers times bytes, summed over a block, stay below 2^63.
PRIMES, BASE = (2_147_483_647, 2_147_483_629), 1_000_003
#: Code points in a chunk of a huge document.
CHUNK = 1 << 15
BLOCK = 1 << 12
#: Members of a group for each copy of the text that they are compared with.
MEMBERS = 2000


def powers(prime: int, n: int = BLOCK) -> np.ndarray:
    """x^(n-1) .. x^0."""
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * BASE % prime)
    return np.array(out[::-1], np.int64)


def polynomial(data: bytes, prime: int, table: np.ndarray) -> int:
    values, h = np.frombuffer(data, np.uint8), 0
    for i in range(0, len(values), BLOCK):
        part = values[i : i + BLOCK].astype(np.int64) + 1
        h = (h * pow(BASE, len(part), prime) + int(part @ table[BLOCK - len(part) :])) % prime
    return h


def combined(parts: list[tuple[int, int]], prime: int) -> int:
    """The fingerprint of a text from (length, fingerprint) of its chunks in order."""
    h = 0
    for n, x in parts:
        h = (h * pow(BASE, n, prime) + x) % prime
    return h


def _hasher(primes: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [powers(p) for p in primes]
        for batch in batches:
            texts = [t.translate(None, SPACES.encode()) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            prints = [[polynomial(t, p, table) for p, table in zip(primes, tables, strict=True)] for t in texts]
            added = [pa.array(map(len, texts), pa.int64()), pa.array([x[0] for x in prints], pa.int64()), pa.array([x[1] for x in prints], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("n_chars"), *added], ["doc_id", "part", "n_chars", "n", "h1", "h2", "sha"])

    return run


def _combiner(primes: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                parts.sort(key=lambda p: p["part"])
                out.append([sum(p["n"] for p in parts), *(combined([(p["n"], p[h]) for p in parts], prime) for h, prime in zip(("h1", "h2"), primes, strict=True))])
            cols = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n", "h1", "h2"])

    return run


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def chunks(text: Column, chunk: int) -> Column:
    """The text in parts of ``chunk`` code points."""
    last = F.floor((F.char_length(text) - 1) / chunk).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), lambda i: F.substring(text, i * chunk + 1, F.lit(chunk)))


def fingerprints(docs: DataFrame, primes: tuple[int, int] = PRIMES, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_chars, text_sha256, fp): fp is (n, h1, h2). Texts longer than ``chunk`` are hashed as chunk rows."""
    bounded_batches(docs.sparkSession)
    texts = named(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    kinds = "doc_id long, part int, n_chars long, n long, h1 long, h2 long, sha string"
    short = texts.where(F.col("n_chars") <= chunk).select("doc_id", "text", F.lit(0).alias("part"), "n_chars").mapInArrow(_hasher(primes), kinds)
    huge = texts.where(F.col("n_chars") > chunk)
    rows = huge.select("doc_id", "n_chars", F.posexplode(chunks(F.col("text"), chunk)).alias("part", "text")).repartition("doc_id", "part")
    parts = rows.select("doc_id", "text", "part", "n_chars").mapInArrow(_hasher(primes), kinds)
    whole = parts.groupBy("doc_id").agg(F.collect_list(F.struct("part", "n", "h1", "h2")).alias("parts")).mapInArrow(_combiner(primes), "doc_id long, n long, h1 long, h2 long")
    sha = huge.select("doc_id", "n_chars", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("sha"))
    both = short.select("doc_id", "n_chars", "sha", "n", "h1", "h2").unionByName(sha.join(whole, "doc_id"))
    return both.select("doc_id", "n_chars", F.col("sha").alias("text_sha256"), F.struct("n", "h1", "h2").alias("fp"))


def duplicates(docs: DataFrame, primes: tuple[int, int] = PRIMES, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each document.

    Only documents whose fingerprint occurs again send their text anywhere: to meet, chunk by chunk,
    the text of the smallest doc_id with the fingerprint. That one has a row for each chunk and each
    ``MEMBERS`` of its group, over which members are dealt by a hash. Documents that differ from it, should a collision
    ever occur, form groups of their own by SHA-256.
    """
    docs = one_row_per_id(docs)
    prints = written(fingerprints(docs, primes, chunk), "prints")
    again = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("times")).where("times > 1"), "again")
    members = join_groups(prints.select("doc_id", "fp"), again, ["fp"], "times").where("times IS NOT NULL")
    members = written(members.select("doc_id", "first_id", F.ceil(F.col("times") / MEMBERS).alias("lots")), "members")
    texts = named(docs).join(members, "doc_id").select("doc_id", "first_id", "lots", F.posexplode(chunks(normalised(F.col("text")), chunk)).alias("part", "piece"))
    firsts = texts.where("doc_id = first_id").select("first_id", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.col("piece").alias("first_piece"))
    others = texts.where("doc_id != first_id").withColumn("lot", F.pmod(F.xxhash64("doc_id"), "lots"))
    same = others.join(firsts, ["first_id", "part", "lot"], "left")
    differs = same.where(~F.col("piece").eqNullSafe(F.col("first_piece"))).select("doc_id").distinct()
    keyed = prints.join(differs.withColumn("differs", F.lit(True)), "doc_id", "left").withColumn("other", F.when(F.col("differs"), F.col("text_sha256")).otherwise(""))
    keyed = written(keyed.select("doc_id", "n_chars", "text_sha256", "fp", "other"), "keyed")
    groups = keyed.groupBy("fp", "other").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("keep_id"), F.count("*").alias("group_size"))
    joined = join_groups(keyed, written(groups.where("group_size > 1"), "groups"), ["fp", "other"], "group_size")
    keep_id = F.coalesce("keep_id", "doc_id")
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (F.col("doc_id") == keep_id).alias("kept"), "text_sha256")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of equal texts."""
    gone = duplicates(docs).where(~F.col("kept")).select("doc_id")
    return one_row_per_id(docs).where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_polynomial_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents WHERE doc_id IS NOT NULL
), groups AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM groups
"""
