"""Token ids in Arrow files of fixed-size-list batches.

A file holds a range of doc_ids in ascending order. Its documents' ids follow one another without a
gap and are cut into sequences of equal length; a record batch has, for each sequence, a fixed-size
list of ids, one of mask bits (false: padding after the file's last token), one of bits that mark
the last token of a document, and the doc_ids that end in it. Buffers are not compressed, so a
reader maps a file into memory and takes any sequence and its mask as views, without a copy; a mask
is, as Arrow keeps booleans, a bit for each token.

Ids are unsigned 16-bit where the vocabulary has fewer than 65,536 of them, else 32-bit. Files are
written under names of their own by each attempt of a task and count only once the manifest, a table
that Spark commits, names them: a lost executor leaves at most a file that nobody reads.

Nulls: a null text is an empty one and has just the end id; rows without a doc_id are left out;
rows that repeat a doc_id stand in the order of their texts. Texts of any length are written whole,
over as many sequences as they take. An empty table gives no file. Extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakfield.llm.common import bounded_batches, documents, named, scratch_path, written
from peakfield.llm.encoding import encoded

#: Sequences in a record batch.
ROWS = 256


def schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64()))])


def record_batch(ids: np.ndarray, ends: np.ndarray, doc_ids: np.ndarray, length: int, kind: pa.DataType) -> pa.RecordBatch:
    """Whole sequences of ``ids``, the last one padded with zeros; doc_ids: of the marks in ``ends``, in order."""
    n = -(-len(ids) // length)
    pad = n * length - len(ids)
    mask = np.concatenate([np.ones(len(ids), bool), np.zeros(pad, bool)])
    ids, ends = np.pad(ids, (0, pad)), np.pad(ends, (0, pad))
    at = np.concatenate([[0], np.cumsum(ends.reshape(n, length).sum(axis=1))]).astype(np.int32)
    fixed = lambda x, t: pa.FixedSizeListArray.from_arrays(pa.array(x, t), length)
    return pa.RecordBatch.from_arrays([fixed(ids, kind), fixed(mask, pa.bool_()), fixed(ends, pa.bool_()), pa.ListArray.from_arrays(pa.array(at), pa.array(doc_ids, pa.int64()))], schema=schema(length, kind))


def _writer(folder: str, path: str, end: int, length: int, kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        sink = name = None
        held, n_held, doc_ids, least, total, n_docs = [], 0, [], None, 0, 0

        def flush(keep: int) -> None:
            """Writes all but the last ``keep`` ids."""
            nonlocal held, n_held, doc_ids
            ids = np.concatenate([x for x, _ in held])
            ends = np.concatenate([x for _, x in held])
            cut = len(ids) - keep
            done = int(ends[:cut].sum())
            for i in range(0, cut, ROWS * length):
                part = ends[i : min(cut, i + ROWS * length)]
                before = int(ends[:i].sum())
                out.write_batch(record_batch(ids[i : i + len(part)], part, np.array(doc_ids[before : before + int(part.sum())], np.int64), length, kind))
            held, n_held, doc_ids = [(ids[cut:], ends[cut:])], keep, doc_ids[done:]

        for batch in batches:
            if sink is None and batch.num_rows:
                files.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.arrow"
                sink = files.open_output_stream(f"{base}/{name}")
                out = pa.ipc.new_file(sink, schema(length, kind))
                least = batch.column("doc_id")[0].as_py()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text").to_pylist(), path, end), strict=True):
                x = np.frombuffer(ids, "<u4").astype(kind.to_pandas_dtype())
                mark = np.zeros(len(x), bool)
                mark[-1] = True
                held.append((x, mark))
                doc_ids.append(doc_id)
                total, n_docs, n_held = total + len(x), n_docs + 1, n_held + len(x)
                if n_held >= ROWS * length:
                    flush(n_held % (ROWS * length))
        if sink is not None:
            if n_held:
                flush(0)
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "least_id": [least], "n_docs": [n_docs], "n_tokens": [total]})

    return run


def file_bytes(size: int) -> int:
    """Text in a file, of ``size`` bytes in all: it grows with the data from 24 to 512 MB, so that files and manifest stay few."""
    return min(512 << 20, max(24 << 20, size // 4096))


def write_files(docs: DataFrame, folder: str, path: str, end: int, length: int = 2048, vocabulary_size: int = 50_257, bytes_per_file: int | None = None) -> DataFrame:
    """Encodes, writes the files and returns the manifest: (file, least_id, n_docs, n_tokens, start).

    ``start`` is the number of ids in the files before. Documents are range-partitioned by doc_id so
    that a file holds about ``bytes_per_file`` of text (``file_bytes`` if not given). A writer streams, so a file's size is
    not held in memory; the manifest has a row for each file.
    """
    bounded_batches(docs.sparkSession)
    texts = named(docs)
    size = texts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    kind = pa.uint16() if vocabulary_size <= 1 << 16 else pa.uint32()
    dealt = texts.repartitionByRange(max(1, -(-size // (bytes_per_file or file_bytes(size)))), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(dealt.mapInArrow(_writer(folder, path, end, length, kind), "file string, least_id long, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("least_id", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def documents_of_file(reader: pa.ipc.RecordBatchFileReader) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each document of a file, in order: its doc_id and its ids, as views of the sequences it lies in."""
    parts: list[np.ndarray] = []
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids = batch.column("input_ids").flatten().to_numpy()
        real = int(np.count_nonzero(batch.column("mask").flatten().to_numpy(zero_copy_only=False)))
        stops = np.flatnonzero(batch.column("ends").flatten().to_numpy(zero_copy_only=False)) + 1
        at = 0
        for doc_id, stop in zip(batch.column("doc_ids").flatten().to_pylist(), stops.tolist(), strict=True):
            yield doc_id, [*parts, ids[at:stop]]
            parts, at = [], stop
        if at < real:
            parts = [*parts, ids[at:real].copy()]


def _reader(folder: str) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        for frame in frames:
            for row in frame.itertuples():
                out, start = [], row.start
                with files.open_input_file(f"{base}/{row.file}") as source, pa.ipc.open_file(source) as reader:
                    for doc_id, parts in documents_of_file(reader):
                        crc = n = 0
                        for x in parts:
                            crc, n = zlib.crc32(x.astype("<u4"), crc), n + len(x)
                        out.append((doc_id, start, n, crc))
                        start += n
                yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files the manifest names."""
    files = manifest.count()
    dealt = manifest.repartition(max(1, files), "file")
    return dealt.select("file", "start").mapInPandas(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def sequence(folder: str, file: str, index: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """The ids and the mask of one sequence of a file: both are views of the mapped file."""
    files, base = pa.fs.FileSystem.from_uri(folder)
    source = pa.memory_map(f"{base}/{file}") if isinstance(files, pa.fs.LocalFileSystem) else files.open_input_file(f"{base}/{file}")
    batch = pa.ipc.open_file(source).get_batch(index // ROWS)
    ids, mask = batch.column("input_ids"), batch.column("mask")
    return ids[index % ROWS].values.to_numpy(), mask[index % ROWS].values


def op6_arrow_ids(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json", end: int = 2, length: int = 2048) -> DataFrame:
    folder = scratch_path(spark, "token-ids")
    manifest = write_files(documents(spark, sf_dir), folder, public_tokenizers.path(vocabulary), end, length)
    return read_files(manifest, folder)
