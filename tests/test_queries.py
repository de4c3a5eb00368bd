"""Every query against its SQL, on the smallest of the driver's tables."""

import datetime
import glob
import os

import duckdb
import pytest

from peakfield.jobs import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return db


def plain(rows):
    def one(v):
        return round(v, 9) if isinstance(v, float) else v if not isinstance(v, datetime.datetime) else v.isoformat()

    return sorted((tuple(map(one, r)) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = tables.sql(f"SELECT {columns} FROM ({SQL[name]})").fetchall()
    assert plain(map(tuple, got.collect())) == plain(want)


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)
