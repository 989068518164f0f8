"""Binary files: readers by ranges, writers with commit, publishing of bundles."""

import hashlib
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgraph.sources import files, sinks, tables


@pytest.fixture
def edges(spark):
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 500, (3000, 2))} | {(77, k) for k in range(500)})
    return spark.createDataFrame([(a, b, float(np.float32(rng.random() + 0.1))) for a, b in pairs], "src long, dst long, w double").repartition(5)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_written_and_read_in_parts(spark, edges, tmp_path, monkeypatch):
    path = str(tmp_path / "g.bin")
    raw, digest = sinks.binary_graph(edges, 510)
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            made = files.save_graph_file(edges, 510, path)
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert (tmp_path / "g.bin").read_bytes() == raw
        assert made == {"nodes": 510, "edges": edges.count(), "sha256": digest, "bytes": len(raw)}
    assert sorted(os.listdir(tmp_path)) == ["g.bin", "g.bin.json"]
    for size in (1 << 16, 100, 3):  # the planner runs in a process of its own: limits are the reader's own
        monkeypatch.setattr(files, "ROWS", size)
        monkeypatch.setattr(files, "EDGES", size)
        reader = files.GraphReader({"path": path})
        parts = reader.partitions()
        got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(got) == sorted(map(tuple, edges.collect())) and max(p.stop - p.start for p in parts) <= size
    assert rows(tables.binary_graph(spark, path)) == rows(edges)


def test_one_large_file_is_many_tasks(spark, tmp_path):
    n, m = 100_000, 5_000_000
    offsets = np.linspace(0, m, n + 1).astype("<u4")
    with open(tmp_path / "big.bin", "wb") as f:
        f.write(files.GRAPH_MAGIC + struct.pack("<II", n, m) + offsets.tobytes())
        f.write((np.arange(m) % n).astype("<u4").tobytes() + np.ones(m, "<f4").tobytes())
    df = tables.binary_graph(spark, str(tmp_path / "big.bin"))
    assert df.rdd.getNumPartitions() >= 5
    got = df.agg(F.count("*"), F.sum("src"), F.sum("dst"), F.sum("w")).first()
    src = np.repeat(np.arange(n), np.diff(offsets.astype(np.int64)))
    assert tuple(got) == (m, int(src.sum()), int((np.arange(m) % n).sum()), float(m))


def test_wrong_files(spark, tmp_path):
    good = files.GRAPH_MAGIC + struct.pack("<II", 2, 2) + struct.pack("<III", 0, 1, 2) + struct.pack("<II", 1, 0) + struct.pack("<ff", 2.0, 1.0)
    signed = good[:-4] + struct.pack("<f", -1.0)
    cases = {"not a graph": b"no" + good, "short": good[:-1], "offsets": good[:16] + struct.pack("<III", 0, 3, 2) + good[28:], "first": good[:16] + struct.pack("<III", 1, 1, 2) + good[28:], "target": good[:28] + struct.pack("<II", 1, 2) + good[36:], "nan": good[:-4] + struct.pack("<f", float("nan")), "signed": signed, "empty": b""}
    for name, raw in cases.items():
        (tmp_path / "x.bin").write_bytes(raw)
        with pytest.raises(Exception, match="not a graph file|sizes don't match|wrong offsets|wrong connections"):
            tables.binary_graph(spark, str(tmp_path / "x.bin")).collect()
    (tmp_path / "x.bin").write_bytes(signed)
    assert rows(tables.binary_graph(spark, str(tmp_path / "x.bin"), positive=False)) == [(0, 1, 2.0), (1, 0, -1.0)]
    for option in ({"bytes": len(signed) - 1}, {"scale": 0}, {"scale": 11}):
        with pytest.raises(Exception, match="sizes don't match|recurrence scale"):
            tables.binary_graph(spark, str(tmp_path / "x.bin"), positive=False, **option).collect()
    none = files.GRAPH_MAGIC + struct.pack("<III", 0, 0, 0)
    (tmp_path / "x.bin").write_bytes(none)
    assert rows(tables.binary_graph(spark, str(tmp_path / "x.bin"))) == []
    assert files.save_graph_file(spark.createDataFrame([], "src long, dst long, w double"), 0, str(tmp_path / "none.bin"))["sha256"] == hashlib.sha256(none).hexdigest()


def test_a_failed_task_leaves_nothing(spark, edges, tmp_path):
    path = str(tmp_path / "g.bin")
    broken = edges.withColumn("w", F.when(F.col("dst") == 499, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("w")))
    with pytest.raises(Exception, match="lost"):
        files.save_graph_file(broken, 510, path)
    with pytest.raises(Exception, match="wrong connections"):
        files.save_graph_file(edges, 400, path)
    assert os.listdir(tmp_path) == []
    files.save_graph_file(edges, 510, path)
    before = (tmp_path / "g.bin").read_bytes()
    with pytest.raises(Exception, match="wrong connections"):
        files.save_graph_file(edges.withColumn("w", F.lit(float("nan"))), 510, path)
    assert (tmp_path / "g.bin").read_bytes() == before and sorted(os.listdir(tmp_path)) == ["g.bin", "g.bin.json"]


def test_anatomy_in_parts(spark, tmp_path, monkeypatch):
    bodies = spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") + 10**9).alias("body_id"), *(F.when(F.col("id") % 3 > 0, F.col("id") * k).alias(c) for k, c in ((1, "x"), (-2, "y"), (3, "z"))), F.when(F.col("id") % 3 > 0, 9).otherwise(2).cast("int").alias("flags")).repartition(4)
    path = str(tmp_path / "a.bin")
    made = files.save_anatomy_file(bodies, path)
    raw, digest = sinks.binary_anatomy(bodies)
    assert (tmp_path / "a.bin").read_bytes() == raw and made["sha256"] == digest and made["located"] == 666
    assert rows(tables.binary_anatomy(spark, path)) == rows(bodies)
    monkeypatch.setattr(files, "BODIES", 7)
    reader = files.AnatomyReader({"path": path})
    assert sorted(r["node"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()) == list(range(1000))
    for wrong in (bodies.withColumn("flags", F.lit(8)), bodies.where("idx <> 5"), bodies.where("idx > 0")):
        with pytest.raises(Exception, match="missing place|out of order"):
            files.save_anatomy_file(wrong, str(tmp_path / "b.bin"))
    assert not [f for f in os.listdir(tmp_path) if f.startswith("b.bin")]


def test_bundles_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows_ = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.repeat(F.col("id").cast("string"), 5).alias("content")).repartition(4)
    wanted = {f"f{i}": hashlib.sha256((str(i) * 5).encode()).hexdigest() for i in range(40)}
    for wrong, message in ((rows_.where("name <> 'f7'"), "missing: .'f7'"), (rows_.unionAll(rows_.limit(1)), "twice"), (rows_.withColumn("content", F.lit("x")), "other content"), (rows_.withColumn("content", F.when(F.col("name") == "f9", F.raise_error(F.lit("lost")).cast("string")).otherwise("x")), "lost"), (rows_.withColumn("name", F.lit("a/b")), "not a name")):
        with pytest.raises(Exception, match=message):
            files.save_bundle(wrong, path, wanted)
        assert os.listdir(tmp_path) == []
    manifest = files.save_bundle(rows_, path, wanted)
    assert {f["name"]: f["sha256"] for f in manifest["files"]} == wanted and sorted(os.listdir(path)) == sorted([*wanted, "manifest.json"])
    with pytest.raises(Exception, match="out"):
        files.save_bundle(rows_, path, wanted)
    assert len(files.save_bundle(rows_.limit(3), path, overwrite=True)["files"]) == 3 and len(os.listdir(path)) == 4
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["files"][0]["bytes"] > 0
