"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from recollect.plans import registry
from recollect.sources.readers import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for t in TABLES:
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return d


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    q = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(q.columns) == columns
    places = [q.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in q.fetchall()), key=repr)
    assert got or name == "search_denied"


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
