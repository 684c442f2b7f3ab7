"""Every query of the entry module over the smallest tables: with SQL, both
must agree; without, it must run and have named columns."""

import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else v if v is None else str(v)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_agrees_with_its_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in entry.oracle_sql():
        out = db.execute(entry.oracle_sql()[name])
        at = [d[0] for d in out.description]
        assert sorted(at) == columns
        assert got == Counter(tuple(plain(r[at.index(c)]) for c in columns) for r in out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
