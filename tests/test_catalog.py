"""Every query of the catalogue runs on the smallest tables; those with SQL agree with it."""

import os

import duckdb
import pandas as pd
import pytest

from trustmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, (list, tuple)) or getattr(x, "shape", ()):
        return str([plain(y) for y in x])
    if x is None or x is pd.NA or x != x:
        return "NULL"
    if isinstance(x, str):
        return x
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    return "%.7g" % float(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)
