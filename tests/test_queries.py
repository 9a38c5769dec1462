"""Every analytics query against its oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from waymark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        some = df[c].dropna()
        if len(some) and hasattr(some.iloc[0], "isoformat"):
            df[c] = pd.to_datetime(df[c]).astype(str)
        elif len(some) and not isinstance(some.iloc[0], str):
            df[c] = df[c].astype(float).round(5) + 0.0
    text = df.astype(str).replace({"None": "nan", "NaT": "nan", "<NA>": "nan"})
    return sorted(map(tuple, text.values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    else:
        assert len(got) and len(got.columns)
