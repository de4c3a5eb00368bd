"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints lie in tiles. A tile holds fingerprints with equal population counts in each of a few
bit blocks; since the counts of two fingerprints differ by no more than the fingerprints do, a pair
of tiles whose counts differ by more than the radius, summed over the blocks, is skipped, and nothing
is lost. The pairs of tiles that are left are compared whole, with numpy's exclusive-or and bit
count, in tasks that Spark deals out. A task returns the links of a spanning forest of what it
found, never all pairs of a group.

Nulls: a null text counts as empty (fingerprint zero, linked like any other); rows without a doc_id
are left out. Repeated rows each get their row in the result. Texts of any length are hashed whole, in one
pass. Ties: a bit set in exactly half of the hashes is 0; of equal fingerprints the smallest doc_id stands for
all. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfield.llm.common import bounded_batches, documents, named, one_row_per_id, written
from peakfield.llm.components import connected_components

SEED = 42
#: Near copies: sets of so many shingles at most are candidates within this wider radius.
FEW, FEW_RADIUS = 40, 48
#: Tiles of a cell that one key of the join holds.
BESIDE = 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; a shorter text is one run, an empty one none."""
    found = text.lower().split()  # of bytes: A-Z and ASCII white space only
    n = len(found)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)] if n else [], np.uint64)
    joined, size = b" ".join(found), np.fromiter(map(len, found), np.int64, n)
    stop = np.cumsum(size + 1) - 1
    starts, stops = (stop - size)[: n - words + 1].tolist(), stop[words - 1 :].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second 64 bits from the first, by a fixed bijective mixer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = np.ascontiguousarray(h[i : i + 65_536])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def _fingerprinter(words: int, wide: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                h = shingle_hashes(text, words)
                h = np.unique(h) if wide else h
                prints.append([majority(h), majority(_mixed(h))] if wide else [majority(h)])
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "fp", "size"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, wide: bool = False) -> DataFrame:
    """(doc_id, fp array<long>, size). ``wide``: 128 bits over distinct shingles, else 64 over all of them."""
    bounded_batches(docs.sparkSession)
    return named(docs).mapInArrow(_fingerprinter(words, wide), "doc_id long, fp array<long>, size long")


def spanning(hits: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Of the links (row, column) in ``hits`` those of a spanning forest. same: rows and columns are the same nodes."""
    rows, cols = np.nonzero(hits)
    shift = 0 if same else hits.shape[0]
    if len(rows) > 20_000:  # dense: breadth first, a whole frontier at a time
        links, row_new, col_new = [], hits.any(axis=1), hits.any(axis=0)
        while row_new.any():
            front = np.flatnonzero(row_new)[:1]
            row_new[front] = False
            while len(front):
                block = hits[front][:, col_new]
                found = block.any(axis=0)
                at = np.flatnonzero(col_new)[found]
                links += zip(front[block[:, found].argmax(axis=0)].tolist(), at.tolist(), strict=True)
                col_new[at] = False
                block = hits[:, at][row_new]
                found = block.any(axis=1)
                front = np.flatnonzero(row_new)[found]
                links += zip(front.tolist(), at[block[found].argmax(axis=1)].tolist(), strict=True) if len(at) else ()
                row_new[front] = False
        return links
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    links = []
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        a, b = root(i), root(j + shift)
        if a != b:
            parent[a] = b
            links.append((i, j))
    return links


def near(a: np.ndarray, b: np.ndarray, radius: int | np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (n x words, uint64) differ in ``radius`` bits at most; it may be a number for each pair."""
    out = np.empty((len(a), len(b)), bool)
    for i in range(0, len(a), 128):
        bits = np.bitwise_count(a[i : i + 128, None, 0] ^ b[None, :, 0])
        for k in range(1, a.shape[1]):
            bits = bits + np.bitwise_count(a[i : i + 128, None, k] ^ b[None, :, k])
        out[i : i + 128] = bits <= (radius[i : i + 128] if isinstance(radius, np.ndarray) else radius)
    return out


def _sides(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row, the ids, fingerprints and sizes of a tile."""
    tiles = batch.column(name)
    at, inner = tiles.offsets.to_numpy(), tiles.values
    ids, size = (inner.field(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "size"))
    prints = inner.field("fp")
    bits = prints.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1) if len(ids) else np.empty((0, 1), np.uint64)
    for i, j in zip(at[:-1], at[1:], strict=True):
        yield ids[i:j], bits[i:j], size[i:j]


def _linker(radius: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for (ia, fa, _), (ib, fb, _), same in zip(_sides(batch, "tile_a"), _sides(batch, "tile_b"), batch.column("same").to_pylist(), strict=True):
                for i, j in spanning(near(fa, fb, radius), same):
                    if ia[i] != ib[j]:
                        out_a.append(int(ia[i]))
                        out_b.append(int(ib[j]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def block_counts(blocks: int) -> list[Column]:
    """The population count of each of ``blocks`` equal parts of a 64-bit fingerprint."""
    width = 64 // blocks
    word = F.col("fp")[0]
    return [F.bit_count(F.shiftrightunsigned(word, width * i).bitwiseAND((1 << width) - 1)).cast("long") for i in range(blocks)]


def count_cells(blocks: int, radius: int) -> tuple[Column, list[int]]:
    """The cell of a fingerprint, from its block counts, and how much the cells to compare it with are greater.

    Of a cell and its mirror image only one side is listed, and the cell itself.
    """
    base = 256
    cell = sum((n * base**i for i, n in enumerate(block_counts(blocks))), F.lit(0))
    steps = [d for d in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, d)) <= radius]
    return cell, sorted(s for s in (sum(x * base**i for i, x in enumerate(d)) for d in steps) if s >= 0)


def tile_pairs(prints: DataFrame, cell: Column, steps: list[int], per_tile: int) -> DataFrame:
    """prints: (doc_id, fp, size) -> (pair, same, tile_a, tile_b): the pairs of tiles to compare.

    A cell with more than ``per_tile`` fingerprints is dealt into several tiles by a hash, and ``BESIDE`` tiles at most
    have the same key in the join, so a hot cell spreads over many tasks. The table of cells has a bounded number of rows
    (as many as there are block counts) and is broadcast.
    """
    prints = prints.withColumn("cell", cell)
    cells = prints.groupBy("cell").agg(F.ceil(F.count("*") / per_tile).alias("parts"))
    tiles = prints.join(F.broadcast(cells), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    tiles = written(tiles.groupBy("cell", "part").agg(F.collect_list(F.struct("doc_id", "fp", "size")).alias("tile")), "tiles")
    keys = tiles.select(F.col("cell").alias("other"), F.floor(F.col("part") / BESIDE).alias("beside")).distinct()  # a few for each cell
    left = tiles.select("cell", "part", F.col("tile").alias("tile_a"), F.explode(F.array(*(F.col("cell") + s for s in steps))).alias("other"))
    left = left.join(F.broadcast(keys.groupBy("other").agg(F.collect_list("beside").alias("_beside"))), "other").withColumn("beside", F.explode("_beside")).drop("_beside")
    right = tiles.select(F.col("cell").alias("other"), F.floor(F.col("part") / BESIDE).alias("beside"), F.col("part").alias("part_b"), F.col("tile").alias("tile_b"))
    pairs = left.join(right, ["other", "beside"]).where("other > cell OR part_b >= part")
    return pairs.select(F.xxhash64("cell", "part", "other", "part_b").alias("pair"), F.expr("other = cell AND part = part_b").alias("same"), "tile_a", "tile_b")


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2, blocks: int = 4, per_tile: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints differ in ``radius`` bits at most are linked.

    Equal fingerprints are first merged into their smallest doc_id, which keeps hot groups of copies
    out of the comparison. Every link between different fingerprints counts, whichever tiles they
    lie in; component_id is the smallest doc_id that links reach.
    """
    prints = written(fingerprints(docs, words).select("doc_id", "fp"), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.lit(0).cast("long").alias("size")), "distinct")
    cell, steps = count_cells(blocks, radius)
    links = tile_pairs(distinct, cell, steps, per_tile).mapInArrow(_linker(radius), "a long, b long")
    found = connected_components(links)
    least = distinct.join(found, F.col("doc_id") == F.col("id"), "left").select("fp", F.coalesce("component", "doc_id").alias("component_id"))
    return prints.join(least, "fp").select("doc_id", "fp", "component_id")


def reach(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """How many bits the fingerprints of sets of ``a`` and ``b`` shingles may differ in, for each pair.

    Sets of ``FEW`` shingles at most differ in more bits at the same similarity, and are cheap to compare.
    """
    larger = np.maximum(a[:, None], b[None, :])
    return np.where(larger <= FEW, max(radius, FEW_RADIUS), radius).astype(np.uint8)


def _candidates(radius: int, similarity: float, block: int) -> Callable:
    """Of a pair of tiles, the documents with a candidate, under the block of the comparison that they meet in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, prints = [], [], []
            for (ia, fa, sa), (ib, fb, sb), same, pair in zip(_sides(batch, "tile_a"), _sides(batch, "tile_b"), batch.column("same").to_pylist(), batch.column("pair").to_pylist(), strict=True):
                hits = near(fa, fb, reach(sa, sb, radius))
                rows, cols = np.nonzero(np.triu(hits, 1) if same else hits)
                fits = np.minimum(sa[rows], sb[cols]) >= similarity * np.maximum(sa[rows], sb[cols]) - 1e-9
                rows, cols = rows[fits], cols[fits]
                where = (np.cumsum(sa) // block)[rows] * 1_000_003 + (np.cumsum(sb) // block)[cols]
                for part in np.unique(where):
                    inside = where == part
                    members = {int(ia[k]): fa[k] for k in np.unique(rows[inside])} | {int(ib[k]): fb[k] for k in np.unique(cols[inside])}
                    keys += [f"{pair}/{part}"] * len(members)
                    ids += members
                    prints += [x.view(np.int64).tolist() for x in members.values()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], ["block", "id", "fp"])

    return run


def _verifier(words: int, radius: int, similarity: float) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].tolist()
        bits = np.array(pdf["fp"].tolist(), np.int64).view(np.uint64)
        sets = [np.unique(shingle_hashes(t.encode(), words)) for t in pdf["text"]]
        sizes = np.array(list(map(len, sets)), np.int64)
        root, links = list(range(len(ids))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near(bits, bits, reach(sizes, sizes, radius)), 1))), strict=True):
            if (a := find(i)) == (b := find(j)):  # linked already through others
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                root[a] = b
                links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 40, per_tile: int = 4096, block: int = 500_000) -> DataFrame:
    """(doc_id, component_id) of documents that have a near copy: Jaccard of word shingles >= ``similarity``.

    128-bit fingerprints give the candidates: unrelated ones differ in about 64 bits, sets of that
    similarity in 19 to 24 on average. The candidates are not lossless: with bits taken as independent, a pair at the
    threshold is missed with a chance of 2e-7 at most where the larger set has 5 to 40 shingles, and of 2.5e-6 where it has
    41 to 100 (at similarity 0.8, the worst split of the sizes). Tiles are cells of equal-ratio sizes, as
    sets that are that similar have sizes within the same ratio. Documents with a candidate are
    sent, once for each block of a tile pair, to a task that compares the shingle sets themselves;
    pairs that links already connect need no comparison. Documents without any word are left alone.
    """
    prints = fingerprints(one_row_per_id(docs), words, wide=True).where("size > 0")
    prints = written(prints, "prints")
    cell = F.floor(F.log("size") / float(-np.log(similarity))).cast("long")
    pairs = tile_pairs(prints, cell, [0, 1], per_tile)
    found = pairs.mapInArrow(_candidates(radius, similarity, block), "block string, id long, fp array<long>")
    found = written(found, "candidates")
    texts = named(one_row_per_id(docs)).withColumnRenamed("doc_id", "id")
    links = found.join(texts, "id").groupBy("block").applyInPandas(_verifier(words, radius, similarity), "a long, b long")
    return connected_components(links).select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller doc_id in their group."""
    gone = near_duplicates(docs, **settings).where("doc_id != component_id").select("doc_id")
    return one_row_per_id(docs).where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
