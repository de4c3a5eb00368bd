"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakfield.llm.common import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its least neighbour (or to itself, if less)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b), long. Returns (id, component), one row for each id that is linked to another.

    ``component`` is the smallest id that can be reached. Links of an id to itself, repeated links
    and nulls are ignored; no links give no rows. Each round is a few hash joins and partial
    aggregations and is written to the shared folder, so lineage stays one round long.
    """
    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges, seen = written(links.where("a != b").select(hi, lo).distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        after = written(_small_star(_large_star(edges).distinct()).distinct(), "links")
        drop_written(edges)
        edges = after
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
