"""Queries through binary files, exports and digest trees, with SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import controls, reservoir
from ..registry import ORACLES, query, table
from ..sources import exports, files, tables
from .graph_queries import WITH, edges, nodes


def _numbered(spark, sf_dir):
    """Nodes (idx, node) and edges (src, dst by idx, w) of the succession graph, and positions of its nodes."""
    n = controls.numbered(nodes(spark, sf_dir).select("node"), ["node"], "i").select((F.col("i") - 1).alias("idx"), "node")
    n = reservoir.checkpointed(n)
    a, b = n.select(F.col("node").alias("src"), F.col("idx").alias("s")), n.select(F.col("node").alias("dst"), F.col("idx").alias("d"))
    e = edges(spark, sf_dir).join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") % 5 > 0, F.col("p_size")).cast("long").alias("x"))
    bodies = n.join(p, "node").select("idx", F.col("node").alias("body_id"), "x", (F.col("x") * 2).alias("y"), (-F.col("x")).alias("z"), F.when(F.col("x").isNotNull(), 9).otherwise(1).cast("int").alias("flags"))
    return n, reservoir.checkpointed(e), bodies


@query(ORACLES["edge_renumber"])
def graph_file(spark, sf_dir):
    """All edges, written as one binary file by ranges and read back by ranges."""
    n, e, _ = _numbered(spark, sf_dir)
    at = exports.shared(spark)
    files.save_graph_file(e, n.count(), at)
    return tables.binary_graph(spark, at).select(F.col("src").alias("src_idx"), F.col("dst").alias("dst_idx"), "w")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS node, p_partkey AS body_id, CASE WHEN p_size % 5 > 0 THEN p_size END::BIGINT AS x, CASE WHEN p_size % 5 > 0 THEN 2 * p_size END::BIGINT AS y, CASE WHEN p_size % 5 > 0 THEN -p_size END::BIGINT AS z, CASE WHEN p_size % 5 > 0 THEN 9 ELSE 1 END::INTEGER AS flags FROM part")
def anatomy_file(spark, sf_dir):
    """All positions, through a binary file."""
    at = exports.shared(spark)
    files.save_anatomy_file(_numbered(spark, sf_dir)[2], at)
    return tables.binary_anatomy(spark, at)


@query(f"""{WITH}, i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM n), k AS (SELECT w FROM e JOIN i a ON src = a.node JOIN i b ON dst = b.node), l AS (SELECT p_size AS x FROM part WHERE p_size % 5 > 0)
SELECT (SELECT count(*) FROM n) AS neurons, (SELECT count(*) FROM k) AS connections, (SELECT coalesce(sum(w), 0) FROM k)::DOUBLE AS contacts, (SELECT 20 + 4 * count(*) FROM n) + (SELECT 8 * count(*) FROM k) AS bytes,
(SELECT count(*) FROM i WHERE idx % greatest(1, (SELECT count(*) // 360 FROM n)) = 0) AS sampled, (SELECT count(*) FROM l) AS located, (SELECT min(x) FROM l)::BIGINT AS least_x, (SELECT max(x) FROM l)::BIGINT AS most_x, (SELECT count(*) FROM k) AS shuffled, true AS agree""")
def graph_export(spark, sf_dir):
    """An export's manifest: graph, anatomy and control in one folder, loaded together and counted while read."""
    n, e, bodies = _numbered(spark, sf_dir)
    at = exports.shared(spark)
    m = exports.export_graph(n, e, at, {"name": "succession"}, bodies, shuffled=True)
    back = exports.Loaded(spark, at)
    for rows in (back.edges, back.bodies, back.shuffled):
        rows.write.format("noop").mode("overwrite").save()
    seen = back.check()
    row = (m["graph"]["neurons"], m["graph"]["connections"], float(m["graph"]["contacts"]), m["graph"]["bytes"], len(m["graph"]["sample"]), m["anatomy"]["located"], m["anatomy"]["bounds"]["least_x"], m["anatomy"]["bounds"]["most_x"], seen["shuffled"]["connections"], seen["anatomy"]["neurons"] == m["graph"]["neurons"] and json.dumps(exports.read_manifest(at), sort_keys=True) == json.dumps(m, sort_keys=True))
    return spark.createDataFrame([row], "neurons long, connections long, contacts double, bytes long, sampled long, located long, least_x long, most_x long, shuffled long, agree boolean")


_CHUNK, _FAN = 2048, 4
_LEAVES = f"l AS (SELECT doc_id, unnest(range(greatest(1, (len(t) + {_CHUNK - 1}) // {_CHUNK}))) AS k, t FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), h0 AS (SELECT doc_id, k, sha256(substr(t, (k * {_CHUNK} + 1)::BIGINT, {_CHUNK})) AS h FROM l)"
_LEVELS = ", ".join(f"h{i} AS (SELECT doc_id, g.k // {_FAN} AS k, CASE WHEN count(*) = 1 AND g.k // {_FAN} = 0 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY g.k)) END AS h FROM h{i - 1} g GROUP BY doc_id, g.k // {_FAN})" for i in range(1, 9))


@query(f"WITH {_LEAVES}, {_LEVELS} SELECT doc_id, chunks, h AS sha256 FROM h8 JOIN (SELECT doc_id, count(*) AS chunks FROM h0 GROUP BY doc_id) USING (doc_id)")
def digest_tree(spark, sf_dir):
    """The root of every document's digest tree."""
    return exports.digest_tree(exports.text_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", _CHUNK), "doc_id", _FAN)


@query(f"WITH {_LEAVES}, c AS (SELECT doc_id, k AS chunk, CASE WHEN doc_id % 7 = 0 AND k = 1 THEN 'changed' WHEN doc_id % 11 = 0 AND k = 0 THEN 'missing' ELSE 'ok' END AS status FROM h0) SELECT doc_id, chunk::INTEGER AS chunk, status FROM c")
def chunk_check(spark, sf_dir):
    """Every chunk of the documents against its digest, where some documents' second chunk was changed and others' first one lost."""
    leaves = exports.text_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", _CHUNK)
    held = leaves.where("NOT (doc_id % 11 = 0 AND chunk = 0)")
    found = held.withColumn("sha256", F.when((F.col("doc_id") % 7 == 0) & (F.col("chunk") == 1), F.reverse("sha256")).otherwise(F.col("sha256")))
    return exports.verified_chunks(found, leaves, "doc_id")
