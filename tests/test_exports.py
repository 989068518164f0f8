"""Exports in two phases, loads that must agree, digest trees."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from mossgraph.operators import reservoir
from mossgraph.sources import exports, files


@pytest.fixture(scope="module")
def parts(spark):
    nodes = spark.range(900).select(F.col("id").alias("idx"), (F.col("id") * 2 + 1).alias("node"))
    edges = nodes.select(F.col("idx").alias("src"), ((F.col("idx") * 7 + 1) % 900).alias("dst"), (F.col("idx") % 5 + 1).cast("double").alias("w"))
    bodies = nodes.select("idx", F.col("node").alias("body_id"), *(F.when(F.col("idx") > 2, F.col("idx") + k).alias(c) for k, c in enumerate("xyz")), F.when(F.col("idx") > 2, 8).otherwise(0).cast("int").alias("flags"))
    return nodes, reservoir.checkpointed(edges), bodies


def test_export_and_what_is_kept(spark, parts, tmp_path, monkeypatch):
    nodes, edges, bodies = parts
    at = str(tmp_path / "e")
    first = exports.export_graph(nodes, edges, at, {"name": "x"}, bodies, shuffled=True)
    assert sorted(os.listdir(tmp_path)) == ["e"] and sorted(os.listdir(at)) == ["anatomy.bin", "graph.bin", "manifest.json", "shuffled.bin"]
    assert exports.read_manifest(at) == first
    for key in ("graph", "anatomy", "shuffled"):
        assert hashlib.sha256((tmp_path / "e" / first[key]["file"]).read_bytes()).hexdigest() == first[key]["sha256"]
    assert first["graph"]["sample"] == [[i, 2 * i + 1] for i in range(0, 900, 2)] and first["anatomy"]["bounds"]["most_z"] == 901 and first["anatomy"]["located"] == 897
    slow = reservoir.spectral_scale(edges, nodes.select(F.col("idx").alias("node"), F.lit(1.0).alias("x")), 0.85, 8).first().factor
    assert abs(0.85 / reservoir.spectral_radius(edges, nodes.select(F.col("idx").alias("node")), 8) - slow) < 1e-9
    monkeypatch.setattr(exports, "scale_of", lambda *_: pytest.fail("the scale is known"))
    again = exports.export_graph(nodes, edges, at, {"name": "y"}, bodies)
    assert again["shuffled"] == first["shuffled"] and again["graph"] == first["graph"] and os.path.exists(f"{at}/shuffled.bin")


def test_failed_export_leaves_the_old_one(spark, parts, tmp_path):
    nodes, edges, bodies = parts
    at = str(tmp_path / "e")
    first = exports.export_graph(nodes, edges, at, {}, bodies)
    with pytest.raises(Exception, match="missing place|differ in number|out of order"):
        exports.export_graph(nodes, edges, at, {}, bodies.where("idx < 800"))
    with pytest.raises(Exception, match="missing place"):
        exports.export_graph(nodes, edges, at, {}, bodies.withColumn("flags", F.lit(8)))
    assert exports.read_manifest(at) == first and os.listdir(tmp_path) == ["e"]


def test_full_export_fails_closed(spark, parts, tmp_path):
    nodes, edges, bodies = parts
    source, to = str(tmp_path / "s"), str(tmp_path / "web")
    assert exports.export_full(spark, source, to, require_full=False) == {"available": False, "missing": ["graph.bin", "anatomy.bin", "shuffled.bin"]}
    exports.export_graph(nodes, edges, source, {}, bodies)
    with pytest.raises(FileNotFoundError, match="shuffled.bin"):
        exports.export_full(spark, source, to, require_full=True)
    made = exports.export_graph(nodes, edges, source, {}, bodies, shuffled=True)
    assert exports.export_full(spark, source, to, require_full=True) == made | {"available": True}
    assert sorted(os.listdir(to)) == ["anatomy.bin", "graph.bin", "manifest.json", "shuffled.bin"]
    raw = bytearray((tmp_path / "s" / "graph.bin").read_bytes())
    raw[40] ^= 1
    (tmp_path / "s" / "graph.bin").write_bytes(bytes(raw))
    with pytest.raises(ValueError, match="damaged: .'graph.bin'"):
        exports.export_full(spark, source, to, require_full=True)
    assert exports.read_manifest(to)["available"] and sorted(os.listdir(tmp_path)) == ["s", "web"]


def test_loads_agree(spark, parts, tmp_path):
    nodes, edges, bodies = parts
    at = str(tmp_path / "e")
    exports.export_graph(nodes, edges, at, {}, bodies)
    back = exports.Loaded(spark, at)
    assert back.shuffled is None and sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, edges.collect())) and back.bodies.where("x IS NULL").count() == 3
    assert back.check() == {"graph": {"connections": 900, "last": 899}, "anatomy": {"neurons": 900, "located": 897}}
    manifest = exports.read_manifest(at)
    import json

    for change in ({"connections": 899}, {"scale": 12.0}, {"bytes": 5}, {"neurons": 5}):
        (tmp_path / "e" / "manifest.json").write_text(json.dumps(manifest | {"graph": manifest["graph"] | change}))
        with pytest.raises(Exception, match="isn't what|recurrence scale|sizes don't match|differ in number"):
            other = exports.Loaded(spark, at)
            other.edges.count()
            other.bodies.count()
            other.check()
    with pytest.raises(FileNotFoundError):
        exports.Loaded(spark, str(tmp_path / "none"))


def test_digests_of_large_files(spark, tmp_path):
    os.mkdir(tmp_path / "d")
    raws = {"a": os.urandom(10_000), "b": b"", "c": os.urandom(999), "d": os.urandom(3000)}
    for name, raw in raws.items():
        (tmp_path / "d" / name).write_bytes(raw)
    leaves = exports.chunk_digests(spark, str(tmp_path / "d"), 1000).withColumn("path", F.element_at(F.split("path", "/"), -1))
    want = {n: [hashlib.sha256(raw[a : a + 1000]).hexdigest() for a in range(0, max(len(raw), 1), 1000)] for n, raw in raws.items()}
    held = reservoir.checkpointed(leaves)
    assert {(r.path, r.chunk): (r.bytes, r.sha256) for r in held.collect()} == {(n, k): (len(raws[n][k * 1000 : k * 1000 + 1000]), h) for n, hs in want.items() for k, h in enumerate(hs)}

    def root(hashes, fan):
        while len(hashes) > 1:
            groups = [hashes[a : a + fan] for a in range(0, len(hashes), fan)]
            hashes = [g[0] if len(g) == 1 and len(groups) == 1 else hashlib.sha256("".join(g).encode()).hexdigest() for g in groups]
        return hashes[0]

    for fan in (2, 3, 256):
        assert {r.path: (r.chunks, r.sha256) for r in exports.digest_tree(held, "path", fan).collect()} == {n: (len(h), root(h, fan)) for n, h in want.items()}
    raw = bytearray(raws["a"])
    raw[4321] ^= 1
    (tmp_path / "d" / "a").write_bytes(bytes(raw) + b"more")
    now = exports.chunk_digests(spark, str(tmp_path / "d"), 1000).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert {(r.path, r.chunk, r.status) for r in exports.verified_chunks(now, held).where("status <> 'ok'").collect()} == {("a", 4, "changed"), ("a", 10, "stray")}
    assert exports.digest_tree(held.limit(0), "path").collect() == []
    rows = spark.createDataFrame([(1, None), (2, "abc" * 1000), (2, "x")], "id int, text string")
    assert exports.text_chunks(rows, "id", "text", 1000).count() == 5


def test_reader_ranges_cover_a_file_once(tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(os.urandom(5000))
    monkeypatch.setattr(files, "BYTES", 2000)
    reader = files.RangesReader({"path": str(tmp_path / "f"), "chunk": "700"})
    got = [r["chunk"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == list(range(8)) and len(reader.partitions()) == 4
