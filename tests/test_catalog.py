"""Every catalogued query against its SQL."""

import datetime
import os

import duckdb
import pytest

from confora.plans import catalog, ensembles, structures  # noqa: F401  the last two add their queries to the catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    want = db.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    key = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=str)
    assert key(rows) == key([tuple(r[i] for i in at) for r in want.fetchall()])
