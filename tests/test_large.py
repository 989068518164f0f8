"""What only tables beyond the given sizes show, on small stand-ins."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from mossgraph import catalog
from mossgraph.operators import blocks, controls, replay, reservoir


def written(at, **tables):
    """A folder of tables, from SQL, and DuckDB's views of them."""
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{at}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    return str(at), con


def test_cases_beyond_a_million(spark, tmp_path):
    orders = "SELECT i AS o_orderkey, i % 50 AS o_custkey, (i * 7919 % 500000)::DOUBLE AS o_totalprice, ['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'][(i % 4)::INTEGER + 1] AS o_orderpriority FROM range(1001001) t(i)"
    at, con = written(tmp_path, orders=orders, customer="SELECT i AS c_custkey, (i % 25)::INTEGER AS c_nationkey, (i - 9)::DOUBLE AS c_acctbal FROM range(50) t(i)")
    assert [tuple(r) for r in catalog.queries()["locked_cases"](spark, at).collect()] == con.execute(catalog.oracle_sql()["locked_cases"]).fetchall()


def test_edges_beyond_a_million(spark, tmp_path):
    lineitem = "SELECT i // 2 AS l_orderkey, i % 2 AS l_linenumber, i AS l_partkey, 0 AS l_suppkey, 0 AS l_quantity, 0 AS l_extendedprice FROM range(2002002) t(i)"
    at, con = written(tmp_path, lineitem=lineitem, part="SELECT i AS p_partkey, 'Brand#11' AS p_brand FROM range(3) t(i)")
    assert [tuple(r) for r in catalog.queries()["ordered_fingerprint"](spark, at).collect()] == con.execute(catalog.oracle_sql()["ordered_fingerprint"]).fetchall()


def test_drawn_edges_are_not_limited_in_one_task(spark, monkeypatch):
    plans, numbered = [], controls.numbered
    monkeypatch.setattr(controls, "numbered", lambda rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or numbered(rows, *a))
    edges = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    made = controls.random_erdos(edges, spark.range(31).select(F.col("id").alias("node")), 3)
    assert made.count() == made.select("src", "dst").distinct().count() == 30
    assert len(plans) == 3 and not any("Limit" in p for p in plans)


def test_cards_run_on_all_cores(spark):
    n = spark.sparkContext.defaultParallelism
    cards = spark.createDataFrame([(i, [float(i % 3)] * replay.DIM) for i in range(4 * n)], "item_id long, u array<double>").coalesce(1)
    graph = reservoir.Compressed(np.array([0, 1]), np.array([1, 2]), np.array([1.0, 2.0]), 3)
    net = replay.Network(graph, (np.array([0]), np.full((1, replay.DIM), 0.1)), np.array([2, 1]), 0.5)
    got = replay.read(cards, net)
    assert got.rdd.getNumPartitions() == n
    by = {r.item_id: r.features for r in got.collect()}
    assert len(by) == 4 * n and by[0] == [0.0, 0.0] and by[1] == by[4] != by[2]


def test_a_broadcast_graph_is_packed_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(reservoir, "STRIP", 7)
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (200, 2))})
    edges = spark.createDataFrame([(a * 2, b * 2, float(1 + (a + b) % 5)) for a, b in pairs], "src long, dst long, w double")
    g, names = reservoir.compressed(edges, spark.range(40).select((F.col("id") * 2).alias("node")))
    assert names == list(range(0, 80, 2)) and len(g.strips) == 6 and {s[3].dtype for s in g.strips} == {np.dtype("uint8")}
    dense = np.zeros((40, 40))
    for a, b in pairs:
        dense[b, a] += 1 + (a + b) % 5
    x = rng.normal(size=(40, 3))
    assert np.allclose(g.incoming(x), dense @ x) and np.allclose(g.incoming(x[:, :1]), dense @ x[:, :1])


def test_blocks_grow_with_the_graph(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCKS", 3)
    nodes = spark.range(50).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(a, (a * 7 + k) % 50, 1.0) for a in range(50) for k in range(4)], "src long, dst long, w double")
    net = blocks.built(edges, nodes, 5, 4, 2, 1.0, size=2)
    assert net.blocks() == 3 and net.cells.count() <= 9
