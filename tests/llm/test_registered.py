"""Registered queries over documents against their SQL, on the driver's smallest tables and on odd rows."""

import os

import duckdb
import pytest

from peakfield.llm import registry

SF = "/root/testdata/sf0.001"


def agree(spark, name, folder):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet{'/*.parquet' if os.path.isdir(f'{folder}/documents.parquet') else ''}'")
    got = registry.queries()[name](spark, folder)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = db.sql(f"SELECT {columns} FROM ({registry.oracle_sql()[name]}) ORDER BY doc_id").fetchall()
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got.orderBy("doc_id").collect()]
    assert rows == [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in want] and rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op5_curriculum", "op7_polynomial_dedup"])
def test_equals_sql(spark, name):
    agree(spark, name, SF)


@pytest.mark.parametrize("name", ["op5_curriculum", "op7_polynomial_dedup"])
def test_equals_sql_on_odd_rows(spark, frame, odd_rows, tmp_path, name):
    """Nulls, ties, other scripts, a long text, a hot group of copies and a null source."""
    rows = [(i, t, "en", ["a", "b", None, "é"][i % 4]) for i, t in odd_rows] + [(10_000 + i, "copied  text" if i % 2 else "copied text", "en", "a") for i in range(200)]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    agree(spark, name, str(tmp_path))
