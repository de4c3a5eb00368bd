"""SpotSigs fingerprints, in DataFrame operations only.

Anchors are the words that stand in at least ``ANCHOR_SHARE`` of the documents, by a count over all of
them. Where a content word, one that is no anchor, follows an anchor or starts a text, a chain is signed:
the anchor, the content word and the content word after it, hashed. The set of a text's signatures,
sorted, is its fingerprint; texts are alike by the Jaccard similarity of these sets. Texts in rarer
languages, code and lists have few anchors or none: where fewer than one content word in ``SPARSE``
starts a chain, in texts of ``SPARSE`` content words at most, and where ``STRETCH`` content words come without an
anchor, every content word starts a chain, with the word before it for an anchor, so that each part of
a text is signed. A text of anchors alone has one signature, of the whole.

For joins, fingerprints are partitioned by set length: sets that are similar enough have lengths
within a fixed ratio, so only equal and neighbouring partitions meet, and there only sets that share
one of the few signatures, rare ones first, that similar sets must share. A pair is pruned without a look at its
sets if they share too few of those signatures, or if the parities of all their signatures under some hash bits
differ in more bits than similar sets of these lengths differ in signatures. Neither loses a pair.

Nulls: a null text is an empty one; without a word there is no signature, and two empty fingerprints
are alike by 1, an empty and another by 0. Rows without a doc_id are left out; of rows that share a
doc_id the one with the greatest text counts. Texts of any length are signed whole, equal texts equally.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfield.llm.common import documents, drop_written, join_groups, named, one_row_per_id, release, written
from peakfield.llm.components import connected_components

#: The share of documents from which a word is an anchor. So there are at most 1 / ANCHOR_SHARE times as many anchors as a text has different words on average.
ANCHOR_SHARE = 0.1
#: Content words for each chain, and content words in a row without an anchor, from which anchors alone do not cover a text.
SPARSE, STRETCH = 8, 32
#: Signatures that joins try last: this many of the most frequent ones, as passages that many texts share have, if they stand in more than this share of the sets.
FREQUENT, FREQUENT_SHARE = 20_000, 1e-4
#: Sets under a signature that one task compares with the others.
LOT = 2_000
#: Longs of parity bits for every set, and for those of pairs that the first do not rule out.
WORDS, MORE_WORDS = 4, 32


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def anchors_of(docs: DataFrame, share: float = ANCHOR_SHARE) -> list[str]:
    """The words that stand in at least ``share`` of the documents, in code-point order."""
    texts = docs.select("text")
    least = texts.count() * share
    counts = texts.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return sorted((r["word"] for r in counts.where((F.col("n") >= least) & (F.col("n") > 1)).select("word").collect()), key=lambda w: w.encode())


def is_anchor(word: Column, anchors: list[str]) -> Column:
    return word.isin(["", *anchors])  # the empty word stands before a text's first


def with_signatures(rows: DataFrame, text: str, out: str, anchors: list[str]) -> DataFrame:
    """Adds ``out``: the distinct chain signatures of ``text`` as sorted numbers, in an array<int>.

    One step is one projection, so that no array is built twice.
    """
    rows = rows.withColumn("_words", words_of(F.col(text)))
    pairs = F.zip_with("_words", F.concat(F.array(F.lit("")), F.col("_words")), lambda w, b: F.struct(w.alias("word"), b.alias("before")))
    rows = rows.withColumn("_spots", F.filter(pairs, lambda x: x["word"].isNotNull() & ~is_anchor(x["word"], anchors)))
    after = F.slice("_spots", F.lit(2), F.greatest(F.size("_spots"), F.lit(1)))
    number = lambda h: (h.bitwiseAND(0xFFFFFFFF) - (1 << 31)).cast("int")
    signed = lambda a, b: number(F.xxhash64(a["before"], a["word"], F.coalesce(b["word"], F.lit(""))))
    rows = rows.withColumn("_every", F.zip_with("_spots", after, lambda a, b: F.struct(is_anchor(a["before"], anchors).alias("starts"), signed(a, b).alias("sig"))))
    n = F.size("_spots")
    starts = F.filter(F.transform("_every", lambda x, i: F.when(x["starts"], i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_starts", starts)
    ends = F.concat(F.slice("_starts", F.lit(2), F.greatest(F.size("_starts"), F.lit(1))), F.array(n))
    stretches = F.filter(F.zip_with("_starts", ends, lambda a, b: F.when(b - a >= STRETCH, F.struct(a.alias("at"), b.alias("to")))), lambda x: x.isNotNull())
    chosen = lambda at: F.transform(at, lambda x: x["sig"])
    sparse = (n <= SPARSE) | (F.size("_starts") * SPARSE < n)
    anchored = chosen(F.filter("_every", lambda x: x["starts"]))
    more = F.flatten(F.transform(stretches, lambda x: chosen(F.slice("_every", x["at"] + 1, x["to"] - x["at"]))))
    sigs = F.when(sparse, chosen(F.col("_every"))).when(n >= STRETCH, F.concat(anchored, more)).otherwise(anchored)
    whole = F.array(number(F.xxhash64(F.concat_ws(" ", "_words"))))
    rows = rows.withColumn(out, F.array_sort(F.array_distinct(F.when((n == 0) & (F.size("_words") > 0), whole).otherwise(sigs))))
    return rows.drop("_words", "_spots", "_every", "_starts")


def written_out(sigs: Column) -> Column:
    """The fingerprint as a string: its signatures as 8 hex digits each."""
    return F.lower(F.concat_ws("", F.transform(sigs, lambda x: F.lpad(F.hex(x.cast("long") + (1 << 31)), 8, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; equal and empty ones need no intersection."""
    apart = (F.size(a) == 0) | (F.size(b) == 0)
    both = F.size(F.array_intersect(a, b))
    value = both / (F.size(a) + F.size(b) - both)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(apart, 0.0).when(a == b, 1.0).otherwise(value)


def with_next_id(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, ...), every doc_id once -> with next_id, the next one by descending doc_id; after the last comes the first.

    A range sort of the ids, without any text, deals them over tasks; what precedes each task's least id comes from
    a table with a row for each task.
    """
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    placed = written(ranged.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)), "ranged")
    tops = placed.groupBy("_part").agg(F.max("doc_id").alias("_top"))
    below = F.lag("_top").over(Window.orderBy("_part"))
    tops = tops.select("_part", F.coalesce(below, F.max("_top").over(Window.partitionBy())).alias("_below"))
    inside = F.lag("doc_id").over(Window.partitionBy("_part").orderBy("doc_id"))
    return placed.join(F.broadcast(tops), "_part").withColumn("next_id", F.coalesce(inside, "_below")).drop("_part", "_below")


def fingerprinted(docs: DataFrame, anchors: list[str] | None = None) -> DataFrame:
    """(doc_id, n_chars, fp array<int>), the signature sets of the whole texts."""
    rows = named(docs)
    rows = with_signatures(rows, "text", "fp", anchors_of(rows) if anchors is None else anchors)
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fp")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are that similar; sizes whose ratio is too small are not intersected."""
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("fp").alias(f"fp_{k}")) for k in "ab")
    joined = pairs.join(left, "a").join(right, "b")
    sizes = [F.size("fp_a"), F.size("fp_b")]
    fits = F.least(*sizes) >= F.greatest(*sizes) * similarity - 1e-9
    return joined.where(F.when(fits, likeness(F.col("fp_a"), F.col("fp_b"))).otherwise(0.0) >= similarity - 1e-9).select("a", "b")


def unlike(a: Column, b: Column, similarity: float) -> Column:
    """How many signatures at most are in only one of two sets, of sizes ``a`` and ``b``, that are that similar."""
    t = similarity - 1e-9
    return (a + b) * ((1 - t) / (1 + t))


def marked(sets: DataFrame, words: int) -> DataFrame:
    """(doc_id, size, bits0, ...), for each set 64 * ``words`` bits: whether an odd number of its signatures hash there.

    A signature that is in only one of two sets changes one bit.
    """
    rows = sets.select("doc_id", F.size("fp").alias("size"), F.explode("fp").alias("x"))
    bit = F.expr(f"shiftleft(1L, (x DIV {words}) & 63)")
    return rows.groupBy("doc_id", "size").agg(*(F.bit_xor(F.when(F.pmod("x", F.lit(words)) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}") for k in range(words)))


def not_ruled_out(words: int, similarity: float) -> Column:
    """Whether sizes and parities, in columns that end in _a and _b, leave it open that two sets are that similar."""
    bits = sum((F.bit_count(F.col(f"bits{k}_a").bitwiseXOR(F.col(f"bits{k}_b"))) for k in range(words)), F.lit(0))
    differ = F.greatest(bits, F.abs(F.col("size_a") - F.col("size_b")))
    return differ <= unlike(F.col("size_a"), F.col("size_b"), similarity) + 1e-6


def possible(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that their sizes and parities, the table ``marks``, do not rule out."""
    left, right = (marks.select(*(F.col(c).alias(f"{c}_{k}") for c in marks.columns)) for k in "ab")
    joined = pairs.join(left, F.col("a") == F.col("doc_id_a")).join(right, F.col("b") == F.col("doc_id_b"))
    return joined.where(not_ruled_out(len(marks.columns) - 2, similarity)).select("a", "b")


def links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are that similar, of those that few bits have left, often of long sets: more bits are counted, then sets are compared."""
    pairs = written(pairs, "possible")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    few = written(sets.join(ids, "doc_id", "left_semi"), "few")
    return alike(possible(pairs, marked(few, MORE_WORDS), similarity), few, similarity)


def frequent_signatures(sets: DataFrame, most: int = FREQUENT) -> list[int]:
    """About the ``most`` most frequent signatures that stand in more than ``FREQUENT_SHARE`` of the sets, by a sketch over all of them.

    They only say which signatures joins try last, so that an estimate will do: results are the same in any order.
    """
    n = sets.count()
    if not n:
        return []
    found = sets.select(F.explode("fp").alias("sig")).agg(F.expr(f"approx_top_k(sig, {most}, {most * 10})").alias("top")).first()["top"] or []
    return sorted(r["item"] for r in found if r["count"] > max(2, n * FREQUENT_SHARE))


def similar(spots: DataFrame, similarity: float = 0.8) -> DataFrame:
    """spots: a written table (doc_id, fp) -> a written table (doc_id, component_id) by links between sets of at least ``similarity``.

    A row for each text with a word. Equal fingerprints count once. Sets of that similarity share one of their first
    size - ceil(similarity * size) + 1 signatures, in any order that is the same for all; here the most frequent ones
    come last, so that what many texts share seldom brings them together. Their sizes are in equal or neighbouring
    partitions. Sets carry their parity bits into the join, which gives only pairs that these leave possible. All sets under a signature are first compared with the smallest doc_id there, which
    joins up hot groups of copies with a link for each; then pairs from different groups are.
    """
    sets = spots.where("size(fp) > 0").select("doc_id", "fp")
    # equal sets have equal 128-bit keys, and different ones for all practical purposes different ones
    named_by = sets.select("doc_id", F.xxhash64("fp").alias("key"), F.xxhash64(F.lit("second"), "fp").alias("key2"))
    firsts = written(named_by.groupBy("key", "key2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("times")), "firsts")
    distinct = written(sets.join(firsts.select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi"), "distinct")
    size, last = F.size("fp"), frequent_signatures(distinct)
    among = f"x IN ({', '.join(map(str, last))})"
    order = F.expr(f"concat(filter(fp, x -> NOT {among}), filter(fp, x -> {among}))") if last else F.col("fp")
    behind = lambda n: F.ceil(n * similarity - 1e-9) - 1  # noqa: E731  (signatures behind the prefix)
    part = F.floor(F.log(size) / -math.log(similarity)).cast("int")
    marks = written(marked(distinct, WORDS), "marks")
    keyed = distinct.select("doc_id", part.alias("part"), size.alias("size"), F.explode(F.slice(order, F.lit(1), (size - behind(size)).cast("int"))).alias("sig"))
    hubs = keyed.groupBy("sig", "part").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n"))
    shared = hubs.groupBy("sig").agg(F.map_from_entries(F.collect_list(F.struct("part", "hub"))).alias("hubs"), F.sum("n").alias("n")).where("n > 1")  # a hub for each part
    # most signatures stand in one set alone
    keyed = written(keyed.join(shared, "sig").select("sig", "part", "size", "doc_id", "n", F.col("hubs")[F.col("part")].alias("hub")), "prefixes")
    starred = keyed.where("doc_id != hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    stars = written(links(possible(starred, marks, similarity), distinct, similarity), "stars")
    groups = connected_components(stars)
    release(spots.sparkSession)
    labelled = keyed.join(groups, F.col("doc_id") == F.col("id"), "left").select("sig", "part", "n", "doc_id", F.coalesce("component", "doc_id").alias("star"))
    several = labelled.groupBy("sig").agg((F.min("star") != F.max("star")).alias("several")).where("several").select("sig")
    labelled = written(labelled.join(several, "sig").join(marks, "doc_id"), "labelled")
    own = ["doc_id", "star", "part", "size", *(f"bits{k}" for k in range(WORDS))]
    # a frequent signature's sets are dealt over lots, and meet a copy of all its sets in each
    lots = F.ceil(F.col("n") / LOT)
    lower = labelled.select("sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("at"), F.pmod(F.xxhash64("doc_id"), lots).alias("lot"), *(F.col(c).alias(f"{c}_a") for c in own))
    upper = labelled.select("sig", F.col("part").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), lots - 1)).alias("lot"), *(F.col(c).alias(f"{c}_b") for c in own))
    apart = (F.col("star_a") != F.col("star_b")) & ((F.col("part_a") != F.col("part_b")) | (F.col("doc_id_a") < F.col("doc_id_b")))
    pairs = lower.join(upper, ["sig", "at", "lot"]).where(apart & not_ruled_out(WORDS, similarity)).select(F.col("doc_id_a").alias("doc_id"), F.col("doc_id_b").alias("other"), F.col("size_a").alias("size"), F.col("size_b").alias("other_size"))
    pairs = pairs.groupBy(F.col("doc_id").alias("a"), F.col("other").alias("b"), "size", "other_size").agg(F.count("*").alias("common"))
    # what two sets share and have not both in their prefixes lies behind the prefix of one of them
    least = (F.col("size") + F.col("other_size") - unlike(F.col("size"), F.col("other_size"), similarity)) / 2 - F.greatest(behind(F.col("size")), behind(F.col("other_size")))
    pairs = pairs.where(F.col("common") >= least - 1e-6).select("a", "b")
    found = connected_components(links(pairs, distinct, similarity).union(stars))
    firsts = firsts.join(found, F.col("first_id") == F.col("id"), "left").select("key", "key2", "times", F.coalesce("component", "first_id").alias("component_id"))
    out = written(join_groups(named_by, written(firsts, "classes"), ["key", "key2"], "times").select("doc_id", "component_id"), "components")
    for table in (distinct, marks, keyed, stars, labelled):
        drop_written(table)
    return out


def compared(docs: DataFrame) -> DataFrame:
    """Each document with its edited text's hash, the fingerprints, both likenesses and its component; without a word it is its own component.

    A document receives from the next one no more than the part of the text that it takes over.
    """
    texts = named(one_row_per_id(docs))
    anchors = anchors_of(texts)
    spots = written(fingerprinted(texts, anchors), "spots")
    release(docs.sparkSession)
    groups = similar(spots).withColumnRenamed("doc_id", "_id")
    release(docs.sparkSession)
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    asks = with_next_id(spots.select("doc_id", tail.alias("need"))).select(F.col("doc_id").alias("asker"), F.col("next_id").alias("doc_id"), "need")
    # the same columns on either side of the join below, so that texts and fingerprints are shuffled once for both
    both = texts.join(spots.select("doc_id", "fp"), "doc_id").withColumn("n_chars", F.char_length("text").cast("long"))
    given = both.join(asks, "doc_id").select(F.col("asker").alias("doc_id"), F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("fp").alias("next_fp"))
    rows = both.join(given, "doc_id")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - tail).cast("int")), "head"))
    rows = with_signatures(rows.drop("text", "head"), "edited", "edited_fp", anchors)
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    return rows.join(groups, F.col("doc_id") == F.col("_id"), "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", written_out(F.col("fp")).alias("fingerprint"), written_out(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "component_id",
    )
