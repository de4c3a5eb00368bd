"""Sharding of linked documents by balanced label propagation, in DataFrame operations only.

Documents are linked if their texts are equal. A group of equal texts is a clique, so what a document
sees of its neighbours is how many of its group lie in each shard: one aggregation stands for all
its edges, and no edge is written out. In each round documents ask to move to the shard that most of
their group is in; a shard admits as many as leave it, plus what it has to spare up to its even share,
and a hash of the group decides who, drawn anew in each round. Documents without neighbours take up no quota, as they
give way in the last pass at no cost; where nearly all have neighbours, quotas are a little over the even share. Rounds go on until
``PATIENCE`` of them in a row have each lowered the number of cut edges by less than ``LEAST_FALL`` of it, as one
unlucky draw mends little. A last pass moves just enough documents, those without neighbours first, to make the
sizes even.

Law ``rows``: shards hold the same number of documents, give or take one. A group that no shard can
hold is cut by a hash into pieces that fill a shard each, and one for the rest. Such pieces, and groups
of over an eighth of a shard, are a bounded number; the first round finds each of them whole in one shard, dealt
the largest first to the emptiest, as propagation from scattered seeds can't tell two of them apart that fill the same
shard. From there they take part in every round, under the same quotas, like all others; their documents are
admitted one by one, as a shard may have room for a part of them only.

Nulls: a null text is an empty one, of size 1; rows without a doc_id are left out. Repeated rows are
linked like any equal texts, and each is placed. Texts of any length count by their bytes. Ties between
shards go by a hash of the group. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfield.llm.common import documents, hashed_buckets, named, running, written

SHARDS = 16
#: The part of the cut edges that a round has to mend to count as a gain, and the rounds without one after which propagation ends.
LEAST_FALL, PATIENCE = 0.01, 4
#: How far linked documents may be over their even share of a shard until the last pass.
SLACK = 0.05


def _pick(values: list, index: Column) -> Column:
    """values[index], of a short list known to the driver."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _counts(nodes: DataFrame, shards: int) -> list[int]:
    found = dict(nodes.groupBy("shard").agg(F.count("*")).collect())  # a row for each shard
    return [found.get(s, 0) for s in range(shards)]


def linked(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, team, large): a team is a group of equal texts, or a piece of one that no shard can hold.

    There are no more than eight groups for each shard that have over an eighth of a shard; these are broadcast, so
    that no task has to meet a whole one.
    """
    text = F.col("text").cast("binary")
    nodes = named(docs).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    nodes = written(nodes, "nodes")
    most = max(1, nodes.count() // shards)
    groups = written(nodes.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    large = groups.where(F.col("n") * 8 > most).select(F.col("digest").alias("_large"), F.col("n").alias("n_large"))
    small = groups.where(F.col("n") * 8 <= most).select(F.col("digest").alias("_small"), F.col("n").alias("n_small"))
    nodes = nodes.join(F.broadcast(large), F.col("digest") == F.col("_large"), "left")
    key = F.when(F.col("n_large").isNull(), F.col("digest")).otherwise(F.col("doc_id").cast("string").cast("binary"))
    nodes = nodes.withColumn("_key", key).join(small, F.col("_key") == F.col("_small"), "left")
    piece = F.when(F.col("n_large") > most, F.floor(F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.lit(1 << 30)) / (1 << 30) * F.col("n_large") / most)).otherwise(0)
    team = F.when(F.coalesce("n_large", "n_small").isNotNull(), F.xxhash64("digest", piece))
    return nodes.select("doc_id", "size", "text_crc32", team.alias("team"), F.col("n_large").isNotNull().alias("large"))


def seeded(nodes: DataFrame, shards: int) -> DataFrame:
    """Adds ``shard``: pieces of large groups whole, the largest first to the emptiest shard, then all others by a hash of the doc_id over what is free.

    A large team has over an eighth of a shard, or is one of the pieces of a group, of which all but one fill a
    shard; so there are about nine for each shard at most, and the driver can deal them.
    """
    nodes = written(nodes, "linked")
    pieces = nodes.where("large").groupBy("team").agg(F.count("*").alias("n")).collect()
    load = [(0, s) for s in range(shards)]
    chosen = []
    for row in sorted(pieces, key=lambda r: (-r["n"], r["team"])):
        n, s = heapq.heappop(load)
        heapq.heappush(load, (n + row["n"], s))
        chosen.append((row["team"], s))
    even = nodes.count() / shards
    free = [max(0.0, even - n) + 1e-9 for n, _ in sorted(load, key=lambda x: x[1])]
    luck, by_hash = F.pmod(F.xxhash64(F.lit("seed"), "doc_id"), F.lit(1 << 30)) / (1 << 30) * sum(free), F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        by_hash = F.when(luck < sum(free[: s + 1]), s).otherwise(by_hash)
    if not chosen:
        return nodes.withColumn("shard", by_hash.cast("int"))
    table = F.create_map(*(F.lit(x) for pair in chosen for x in pair))
    return nodes.withColumn("shard", F.when(F.col("large"), F.try_element_at(table, F.col("team"))).otherwise(by_hash).cast("int"))


def asked(nodes: DataFrame, turn: int) -> DataFrame:
    """Adds ``wish``: the shard where most of the document's team is; of equal ones the same for the whole team, another draw each turn.

    Wishes of large teams, of which there are about nine for each shard at most, are broadcast, so that no task meets a whole one.
    """
    seats = nodes.where("team IS NOT NULL").groupBy("team", "shard", "large").agg(F.count("*").alias("n"))
    wishes = seats.groupBy(F.col("team").alias("_key"), "large").agg(F.max_by("shard", F.struct("n", F.xxhash64(F.lit(turn), "shard", "team"))).alias("wish"))
    wishes = written(wishes, "wishes")
    few, many = wishes.where("large").select("_key", F.col("wish").alias("_few")), wishes.where("NOT large").select("_key", F.col("wish").alias("_many"))
    large = F.col("team").isNotNull() & F.col("large")
    nodes = nodes.join(F.broadcast(few), F.when(large, F.col("team")) == F.col("_key"), "left").drop("_key")
    # documents of no team get a key of their own, as nulls, and large teams, would all meet in one task
    keyed = nodes.withColumn("_key", F.when(F.col("team").isNotNull() & ~F.col("large"), F.col("team")).otherwise(F.xxhash64(F.lit("alone"), "doc_id"))).join(many, "_key", "left")
    wish = F.when(large, F.col("_few")).when(F.col("team").isNotNull(), F.col("_many"))
    return keyed.withColumn("wish", F.coalesce(wish, "shard")).drop("_key", "_few", "_many")


def cut_of(nodes: DataFrame) -> int:
    """Pairs of a team in different shards."""
    seats = nodes.where("team IS NOT NULL").groupBy("team", "shard").agg(F.count("*").alias("n"))
    teams = seats.groupBy("team").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return int(teams.agg(F.sum((F.col("n") * F.col("n") - F.col("squares")).cast("decimal(38,0)"))).first()[0] or 0) // 2


def quotas(flow: dict[tuple[int, int], int], load: list[int], room: float) -> list[float]:
    """For each shard the share of those who ask for it that may come: as many as leave it, and what it has up to ``room``.

    Those who leave are themselves let in elsewhere by a share, so the shares start at one and sink until they agree.
    """
    shards = range(len(load))
    asks = [sum(n for (_, t), n in flow.items() if t == s) for s in shards]
    share = [1.0] * len(load)
    while True:
        leave = [sum(n * share[t] for (s, t), n in flow.items() if s == shard) for shard in shards]
        lower = [min(share[t], max(0.0, leave[t] + room - load[t]) / asks[t]) if asks[t] else 1.0 for t in shards]
        if max(a - b for a, b in zip(share, lower, strict=True)) < 1e-3:
            return lower
        share = lower


def admitted(moves: DataFrame, shards: int, turn: int) -> DataFrame:
    """The wishes that come true in a round under the shards' quotas, by a hash of the group, or of the document where the group is large."""
    flow = {(r["shard"], r["wish"]): r["n"] for r in moves.where("wish != shard").groupBy("shard", "wish").agg(F.count("*").alias("n")).collect()}  # shards x shards
    load = _counts(moves.where("team IS NOT NULL"), shards)
    share = quotas(flow, load, max(moves.count() / shards, sum(load) / shards * (1 + SLACK)))
    draw = F.when(F.col("large"), F.xxhash64(F.lit(turn), "doc_id")).otherwise(F.xxhash64(F.lit(turn), "team", "shard"))
    luck = F.pmod(draw, F.lit(1 << 20)) / (1 << 20)
    goes = (F.col("wish") != F.col("shard")) & (luck < _pick(share, F.col("wish")))
    return moves.withColumn("shard", F.when(goes, F.col("wish")).otherwise(F.col("shard"))).drop("wish")


def propagated(nodes: DataFrame, shards: int, least_fall: float = LEAST_FALL, patience: int = PATIENCE) -> DataFrame:
    """Rounds of propagation until the cut stops falling; each is written, so lineage stays one round long."""
    best, idle, turn = math.inf, 0, 0
    while True:
        moves = written(asked(nodes, turn), "round")
        cut = cut_of(moves)
        idle = 0 if cut < best * (1 - least_fall) else idle + 1
        if not cut or idle == patience or moves.where("wish != shard").isEmpty():
            return moves.drop("wish")
        best = min(best, cut)
        nodes, turn = admitted(moves, shards, turn), turn + 1


def evened(nodes: DataFrame, shards: int) -> DataFrame:
    """Moves documents out of shards that have too many, into those that have too few.

    Documents without neighbours go first, so teams are cut only where nothing else is left to move.
    """
    load = _counts(nodes, shards)
    total = sum(load)
    order = sorted(range(shards), key=lambda s: (-load[s], s))
    goal = [0] * shards
    for k, s in enumerate(order):
        goal[s] = total // shards + (k < total % shards)
    over = [max(0, load[s] - goal[s]) for s in range(shards)]
    before = [sum(over[:s]) for s in range(shards)]
    gaps = [max(0, goal[s] - load[s]) for s in range(shards)]
    ends = [sum(gaps[: s + 1]) for s in range(shards)]
    n_buckets = hashed_buckets(max(load, default=0))
    rank = F.when(F.col("team").isNull(), 0).when(~F.col("large"), 1).otherwise(2)
    keyed = nodes.withColumn("bucket", rank * n_buckets + F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)))
    ranked = running(keyed, ["shard"], "bucket", ["doc_id", "size", "text_crc32"], F.lit(1), "place").drop("bucket")
    number = F.col("place") + _pick(before, F.col("shard"))
    target = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        target = F.when(number < ends[s], s).otherwise(target)
    return ranked.withColumn("shard", F.when(F.col("place") < _pick(over, F.col("shard")), target).otherwise(F.col("shard")).cast("int")).drop("place")


def shards_of(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot counts from 0 within the shard, without gaps."""
    nodes = propagated(seeded(linked(docs, shards), shards), shards)
    nodes = written(evened(nodes, shards), "evened")
    n_buckets = hashed_buckets(-(-nodes.count() // shards))
    keyed = nodes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)))
    slots = running(keyed, ["shard"], "bucket", ["doc_id", "size", "text_crc32"], F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")


def cut_edges(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """(cut, edges): pairs of equal texts in different shards, and all such pairs, counted without listing any."""
    nodes = named(docs).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).join(placed.select("doc_id", "shard"), "doc_id")
    seats = nodes.groupBy("digest", "shard").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    groups = seats.groupBy("digest").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return groups.agg(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("cut"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("edges"))


def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards_of(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
