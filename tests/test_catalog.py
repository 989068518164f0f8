"""Every query that SQL can state, against DuckDB; the others run."""

import duckdb
import pytest
from conftest import TABLES

from mossgraph import catalog


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    names = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    if name in catalog.oracle_sql():
        want = duck.execute(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert rows == sorted(tuple(map(plain, r)) for r in want)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
