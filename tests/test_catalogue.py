"""Every catalogue query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from loomtext.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows_of(frame):
    return sorted(repr(tuple(plain(v) for v in row)) for row in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name not in catalogue.ORACLE:
        assert len(got.columns) == len(set(got.columns))
        return
    expected = duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)
