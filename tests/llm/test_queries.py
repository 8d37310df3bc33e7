"""Queries of the subpackage that SQL can express, on the driver's tables."""

import duckdb
import pytest

from recollect.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    d = duckdb.connect()
    for t in ("documents", "pages"):
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    q = d.sql(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(q.columns) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[q.columns.index(c)] for c in columns) for r in q.fetchall()), key=repr)


def test_registered():
    import __spark_entry__ as e

    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in e.queries() if k.startswith("op") and k[2].isdigit()} and "pipeline" in e.queries()
