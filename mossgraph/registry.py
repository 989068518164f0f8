"""Queries by name, each with SQL for the oracle where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its oracle."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


#: Tables whose rows are much work (texts; orders, which stand in for cases), and bytes above which a single file of them is dealt out.
WORK, ONE_TASK = ("documents", "pages", "orders"), 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. A single file may be one row group, which is one task however many cores there are, so where rows are much work it is dealt out; many files are read as they lie."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    rows = spark.read.parquet(path)
    if name in WORK:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where)
        if found.getFileCount() == 1 and ONE_TASK < found.getLength() < 128 << 20:
            return rows.repartition(spark.sparkContext.defaultParallelism)
    return rows
