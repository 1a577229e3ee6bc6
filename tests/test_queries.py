"""Every registered query against its SQL, at the smallest scale."""

import glob
import math
import os

import pytest

import __spark_entry__

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: The optional subpackage has its own tests.
NAMES = [n for n in __spark_entry__._core.QUERIES]


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    want = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in names) for r in found.fetchall()), key=repr)
    assert sorted(columns) == names
    assert rows == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
