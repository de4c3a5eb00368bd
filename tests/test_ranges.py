"""Files by ranges of bytes: every spectrum once, filters before parsing, batches inside one file."""

import base64
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakfield.operators.boxes import filter_ms_level
from peakfield.sources import mzml, mzml_source, ranges, records
from peakfield.streaming import ingest


def element(index, level=1, rt=1.5, mz=(100.0, 200.0), intensity=(5.0, 7.0), binary=None, name="spectrum"):
    level = "" if level is None else f'<cvParam cvRef="MS" value="{level}" accession="{mzml.MS_LEVEL}"/>'
    out = f'<{name} index="{index}" id="scan={index}">{level}<scanList><scan><cvParam accession=\'{mzml.SCAN_START}\' value="{rt}" unitName="minute"/></scan></scanList><binaryDataArrayList count="2">'
    for accession, values in ((mzml.MZ_ARRAY, mz), (mzml.INTENSITY_ARRAY, intensity)):
        data = binary or base64.b64encode(zlib.compress(np.asarray(values, "<f8").tobytes())).decode()
        out += f'<binaryDataArray><cvParam accession="{accession}"/><cvParam accession="{mzml.FLOAT_64}"/><cvParam accession="{mzml.ZLIB}"/><binary>{data}</binary></binaryDataArray>'
    return out + f"</binaryDataArrayList></{name}>"


def document(elements):
    return '<?xml version="1.0"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml"><run>\n<spectrumList count="9">' + "\n ".join(elements) + "</spectrumList></run></mzML>"


@pytest.mark.parametrize("chunk", [1, 7, 64, 4096])
def test_ranges_hold_every_spectrum_once(chunk):
    text = document([element(i, mz=[float(i)] * i, intensity=[1.0] * i) for i in range(6)]).encode()
    for size in (1, 50, 333, 700, len(text)) if chunk > 1 else (700,):
        found = []
        for at in range(0, len(text), size):
            found += [ranges.header(e)["spectrum_index"] for e in ranges.elements(pa.PythonFile(pa.BufferReader(text)), at, min(at + size, len(text)), chunk)]
        assert found == list(range(6))


def test_a_cut_off_file_gives_what_is_whole():
    text = document([element(0), element(1)]).encode()
    cut = text[: text.rfind(b"</spectrum>") + 4]
    assert len(list(ranges.elements(pa.BufferReader(cut), 0, len(cut)))) == 1


def test_headers():
    assert ranges.header(element(3, 2, 0.1).encode()) == {"spectrum_index": 3, "ms_level": 2, "rt": float(np.float32(0.1)), "rt_unit": "minute"}
    assert ranges.header(b"<spectrum >") == {"spectrum_index": None, "ms_level": None, "rt": None, "rt_unit": None}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("mzml")
    good = [element(i, level=[1, 2, None][i % 3], rt=i / 4, mz=[float(i), 2.0, 3.0], intensity=[0.5, 1.0, float(i)]) for i in range(30)]
    (path / "a.mzML").write_text(document(good))
    (path / "b.mzML").write_text(document([element(0), element(1, 2, binary="*"), element(2, 2).replace("<scanList>", "<scanList><broken"), element(3, 1, binary="*")]))
    (path / "_hidden").write_text("no XML")
    mzml_source.register(spark)
    return str(path)


def test_the_source_reads_what_the_text_reader_reads(spark, folder):
    path = f"{folder}/a.mzML"
    want = mzml.decoded(mzml.read_mzml_spectra(spark, path)).select("run_id", "spectrum_index", "rt", "mz", "intensity", "reason").collect()
    for size in (900, 5000, 1 << 20):
        got = spark.read.format("mzml").option("bytesPerPartition", size).load(path).select("run_id", "spectrum_index", "rt", "mz", "intensity", "reason").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("condition", ["ms_level = 1", "ms_level IN (0, 1)", "ms_level != 2 AND rt > 2", "rt >= 0.75 AND rt <= 3.5", "NOT spectrum_index IN (4, 5)", "rt IS NULL", "spectrum_index < 9 OR rt > 6", "ms_level = 2 AND size(mz) = 3"])
def test_filters(spark, folder, condition):
    df = spark.read.format("mzml").load(f"{folder}/a.mzML")
    rows = spark.createDataFrame(df.collect(), df.schema)
    assert {r["spectrum_index"] for r in df.where(condition).collect()} == {r["spectrum_index"] for r in rows.where(condition).collect()}


def test_what_a_filter_rules_out_is_never_parsed(spark, folder, monkeypatch):
    """Neither Spark nor the reader looks further: the filter is gone from the plan, and broken spectra are passed by."""
    df = spark.read.format("mzml").load(folder)
    wanted = filter_ms_level(df)
    assert "Filter (" not in wanted._jdf.queryExecution().executedPlan().toString()
    bad = lambda d: {(r["spectrum_index"], r["ms_level"]) for r in d.where("reason IS NOT NULL").collect()}
    assert bad(df) == {(1, 2), (2, 2), (3, 1)} and bad(wanted) == {(3, 1)}
    parsed = []
    monkeypatch.setattr(ranges, "arrays", lambda e: parsed.append(ranges.header(e)["ms_level"]) or (None, None, "not asked"))
    reader = mzml_source.MzmlReader({"path": folder})
    assert list(reader.pushFilters([mzml_source.D.In(("ms_level",), (0, 1)), mzml_source.D.StringContains(("rt_unit",), "min")])) == [mzml_source.D.StringContains(("rt_unit",), "min")]
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == len(parsed) == 22 and set(parsed) == {1, None}


def test_an_empty_folder(spark, tmp_path):
    assert spark.read.format("mzml").schema(ranges.SPECTRA.replace("ms_level short", "ms_level short NOT NULL")).load(str(tmp_path)).count() == 0


def imported(spark, source, out, at, **more):
    ingest.ingest_stream(spark, source, None, out, at, kind="mzml", strategy="IntensityCutoff", **more).awaitTermination()
    return spark.read.parquet(f"{out}/points")


def values(df, *columns):
    return sorted(map(tuple, df.select("batch", "mz", "rt", "intensity", *columns).collect()))


def test_one_file_in_batches_is_like_many_files(spark, tmp_path):
    """The tree of a file that is cut is that of files that hold its ranges; a batch that is run again, and later files, change nothing before."""
    rnd = np.random.default_rng(3)
    spectra = [element(i, rt=float(i), mz=rnd.uniform(0, 500, 20).round(3), intensity=rnd.integers(1, 90, 20)) for i in range(40)]
    one, many, out, at = (str(tmp_path / x) for x in ("one", "many", "out", "at"))
    os.makedirs(one), os.makedirs(many)
    text = document(spectra)
    open(f"{one}/run.mzML", "w").write(text)
    size = len(text) // 5 + 1
    got = imported(spark, one, out, at, capacity=40, bytes_per_batch=size)
    assert got.select("batch").distinct().count() == 5
    assert sorted(r["point_id"] for r in got.collect()) == list(range(800))
    rows = got.orderBy("point_id").collect()
    assert [r["rt"] for r in rows] == sorted(r["rt"] for r in rows)
    for k in range(5):
        held = ranges.elements(pa.BufferReader(text.encode()), k * size, min((k + 1) * size, len(text)))
        open(f"{many}/{k}.mzML", "w").write(document([e.decode() for e in held]))
        os.utime(f"{many}/{k}.mzML", (10**9 + k, 10**9 + k))
    want = imported(spark, many, str(tmp_path / "out2"), str(tmp_path / "at2"), capacity=40)
    assert values(got, "leaf_depth", "tile_id", "lod") == values(want, "leaf_depth", "tile_id", "lod")
    # the last batch runs again
    before = sorted(map(tuple, got.collect()))
    for log in (f"{at}/commits/4", f"{at}/commits/.4.crc"):
        os.remove(log)
    assert sorted(map(tuple, imported(spark, one, out, at, capacity=40, bytes_per_batch=size).collect())) == before
    # and a new file is new batches
    open(f"{one}/second.mzML", "w").write(document(spectra[:4]))
    after = imported(spark, one, out, at, capacity=40, bytes_per_batch=size)
    assert after.count() == 880 and sorted(map(tuple, after.where("batch < 5").collect())) == before
    joined = ingest.joined_tree(spark, out, 40, strategy="IntensityCutoff")
    assert joined.where("lod = 0").groupBy("run_id").count().where("count > 40").count() == 0


def test_bad_spectra_of_a_cut_file_are_kept_apart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "x.mzML").write_text(document([element(0), element(1, binary="*"), element(2), element(3, 2, binary="*")]))
    imported(spark, str(source), str(tmp_path / "out"), str(tmp_path / "at"), bytes_per_batch=400)
    assert [r["spectrum_index"] for r in spark.read.parquet(str(tmp_path / "out/quarantine")).collect()] == [1]


def test_records_are_cut_at_records(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("point_id"), (F.col("id") / 7).alias("mz"), F.col("id").cast("float").alias("rt"), F.lit(2.0).alias("intensity"), F.lit(1).alias("meta1"))
    records.write_point_records(df.coalesce(1), f"file://{tmp_path}/in").collect()
    ingest.ingest_stream(spark, f"{tmp_path}/in", None, f"{tmp_path}/out", f"{tmp_path}/at", kind="records", bytes_per_batch=24 * 300 + 5).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/points")
    per_file = got.groupBy("run_id").agg(F.count("*").alias("n"), F.countDistinct("point_id").alias("ids"), F.max("point_id").alias("top")).collect()
    assert sum(r["n"] for r in per_file) == 1000 and all(r["n"] == r["ids"] == r["top"] + 1 for r in per_file)
    assert sorted(r["mz"] for r in got.collect()) == [i / 7 for i in range(1000)]


def test_a_kind_that_is_not_cut(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.csv").write_text("1,2,3,4\n")
    with pytest.raises(ValueError, match="not cut"):
        ingest.ingest_stream(spark, f"{tmp_path}/in", None, f"{tmp_path}/out", f"{tmp_path}/at", kind="csv", bytes_per_batch=10)
