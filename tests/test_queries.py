"""Every registered query of the core against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from corpuscle import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(table) -> list[str]:
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    names = sorted(table.column_names)
    return sorted(repr([plain(r[n]) for n in names]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, SF).toArrow()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert found.num_rows > 0
        return
    wanted = duck.execute(sql).to_arrow_table()
    assert sorted(found.column_names) == sorted(wanted.column_names)
    assert rows(found) == rows(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
