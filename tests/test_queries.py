"""Every news-event query against its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidewire.plans import registry


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "None"
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert df.columns
        return
    cur = duck.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(_plain(w[cols.index(c)]) for c in sorted(cols)) for w in cur.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in sorted(cols)) for r in rows) == want
