"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from confluo.plans import queries as core

DATA = "/root/testdata/sf0.001"


def normal(df, columns):
    df = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else str(x) if x is not None else None for x in (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r))) for r in df.values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, DATA).toPandas()
    if name not in core.SQL:
        assert len(got)
        return
    want = duck.sql(core.SQL[name]).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert normal(want, sorted(want.columns)) == normal(got, sorted(want.columns))
