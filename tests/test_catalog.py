"""Every registered query of the reference's operators gives the rows of its SQL in DuckDB."""

import decimal
import math
import os

import duckdb
import pandas as pd
import pytest

from folioscope.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).tz_localize(None).isoformat()
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for name in catalog.TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    got = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())
    assert ours == theirs
