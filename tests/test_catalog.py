"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tremor import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return float(v) if isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry_module():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert catalog.FLAGSHIP in catalog.QUERIES
