"""Every query of the library on tables without rows."""

import duckdb
import pyarrow.parquet as pq
import pytest
from conftest import TABLES

from mossgraph import catalog

#: Answers where SQL's aggregate over nothing differs, or where there is no SQL.
DEFINED = {
    "table_fingerprint": [("5feceb66ffc86f38d952786c6d696c79c2dbc239dd4e91b46729d73a27fb57e9", 0)],
    "power_iteration": [(1.0, 0.0)],
    "multilabel_metrics": [(None, 0, None, None, None, 0.0)],
    "card_collection": [("Mixed", 0), ("law", 0)],
    "ordered_fingerprint": [],
    "observed_domain": [],
    "locked_cases": [],
    "replay_training": [(None, None, None)],
}
#: Long ones, which share their parts with others here.
SLOW = {"replay_session_blocks", "replay_session", "graph_export", "profile_search", "lesions_retrained", "model_comparison", "lesion_study"}


@pytest.fixture(scope="module")
def none(sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("none")
    for t in TABLES:
        pq.write_table(pq.read_table(f"{sf}/{t}.parquet").slice(0, 0), at / f"{t}.parquet")
    return str(at)


def test_every_query(spark, none):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        check(spark, none)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def check(spark, none):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{none}/{t}.parquet'")
    wrong = {}
    for name, query in catalog.queries().items():
        if name in SLOW:
            continue
        try:
            df = query(spark, none)
            names = sorted(df.columns)
            got = sorted(map(tuple, df.select(*names).collect()), key=str)
        except Exception as error:  # noqa: BLE001  (all of them are told together)
            wrong[name] = str(error)[:200]
            continue
        if name in DEFINED:
            want = DEFINED[name]
        elif name in catalog.oracle_sql():
            want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()[name]})").fetchall(), key=str)
        else:
            want = []
        if str(got) != str(want):
            wrong[name] = got[:3], want[:3]
    assert not wrong
