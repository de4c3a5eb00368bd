"""Exact token counts from a length histogram.

Documents are aggregated by encoded length. The histogram has at most one row for each length that
occurs, however many documents there are, and suffix sums over it answer, for every context limit,
how many tokens documents have in total, how many a cut at the limit keeps, and which share of the
documents fits.

Nulls: a null text has the length of an empty one; rows without a doc_id are left out. Equal lengths
are one row; repeated rows count each. Texts of any length are encoded whole. An empty table gives an
empty histogram, zeros at every asked limit, and no quantile. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfield.llm.common import bounded_batches, documents, named, written
from peakfield.llm.encoding import encoded

#: Lengths in a bucket of the two-level suffix sums.
BUCKET = 4096
#: Context limits that are always answered, and shares of the documents whose quantiles are.
CONTEXTS, SHARES = tuple(1 << k for k in range(7, 18)), (0.5, 0.9, 0.99, 0.999)
LIMIT_COLUMNS = ["context_limit", "n_docs", "docs_over", "docs_within", "tokens_over", "tokens_total", "tokens_kept", "tokens_lost", "share_within"]


def _counter(path: str, end: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(ids) // 4 for ids in encoded(batch.column("text").to_pylist(), path, end)]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["n_tokens"])

    return run


def histogram(docs: DataFrame, path: str, end: int | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length, ``end`` counted if given."""
    bounded_batches(docs.sparkSession)
    lengths = named(docs).select("text").mapInArrow(_counter(path, end), "n_tokens long")
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame, *more: str) -> DataFrame:
    """For each length in the histogram, taken as a context limit: what suffix sums say.

    (context_limit, n_docs of that length, docs_over, docs_within, tokens_over of the documents that
    are longer, tokens_total of all, tokens_kept when each is cut at the limit, tokens_lost,
    share_within). Sums run inside buckets of lengths; later buckets add theirs from a table with a
    row for each bucket. ``more``: columns of the histogram to keep.
    """
    hist = hist.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = hist.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bases = sums.select("bucket", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "dt"))
    longer = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("docs_over", F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).withColumn("tokens_over", F.coalesce(F.sum("tokens").over(longer), F.lit(0)))
    joined = hist.join(bases, "bucket").withColumn("docs_over", F.col("docs_over") + F.col("d_later")).withColumn("tokens_over", F.col("tokens_over") + F.col("t_later"))
    kept = F.col("t_all") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return joined.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", "docs_over", (F.col("d_all") - F.col("docs_over")).alias("docs_within"),
        "tokens_over", F.col("t_all").alias("tokens_total"), kept.alias("tokens_kept"), (F.col("t_all") - kept).alias("tokens_lost"),
        F.try_divide(F.col("d_all") - F.col("docs_over"), F.col("d_all")).alias("share_within"), *more,
    )


def quantile(at_limits: DataFrame, share: float) -> DataFrame:
    """(n_tokens): the least length that at least ``share`` of the documents do not exceed."""
    return at_limits.where(F.col("share_within") >= share).agg(F.min("context_limit").alias("n_tokens"))


def truncated_totals(hist: DataFrame, contexts: DataFrame) -> DataFrame:
    """contexts: (context_limit), any limits -> (context_limit, tokens_kept) from the suffix sums.

    A limit is one more length, which no document has; so one pass of suffix sums serves all of them, without a join.
    Nulls among the limits are left out, repeated ones count once.
    """
    asked = contexts.where("context_limit IS NOT NULL").select(F.col("context_limit").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_docs"))
    both = hist.select("n_tokens", "n_docs", F.lit(False).alias("asked")).unionByName(asked.withColumn("asked", F.lit(True)))
    both = both.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"), F.max("asked").alias("asked"))
    return limits(both, "asked").where("asked").select("context_limit", "tokens_kept")


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Every context limit that is the length of some document, the usual ones (kind ``context``), and quantiles, over the whole table.

    Rows of kind ``quantile`` are those of the lengths that SHARES of the documents do not exceed.
    """
    hist = written(histogram(documents(spark, sf_dir), public_tokenizers.path(vocabulary)), "lengths")
    usual = spark.createDataFrame([(c, 0) for c in CONTEXTS], "n_tokens long, n_docs long")
    both = hist.withColumn("kind", F.lit("length")).unionByName(usual.withColumn("kind", F.lit("context")))
    # a usual limit that is some document's length too has a row of each kind, and the documents are on the first
    both = both.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"), F.sort_array(F.collect_set("kind"), asc=False).alias("kinds"))
    at = written(limits(both, "kinds"), "limits")
    rows = at.select(F.explode("kinds").alias("kind"), F.lit(None).cast("double").alias("share"), *LIMIT_COLUMNS)
    for share in SHARES:
        rows = rows.unionByName(at.join(quantile(at, share).select(F.col("n_tokens").alias("context_limit")), "context_limit").select(F.lit("quantile").alias("kind"), F.lit(share).alias("share"), *LIMIT_COLUMNS))
    return rows
