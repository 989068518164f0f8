"""Exports in two phases and loads that must agree: graph, anatomy and control files with one manifest; digest trees of large files.

An export is built in a folder beside its target and renamed when all of it is there, so a reader sees the old one or the new one.
A load takes its numbers from the manifest, has each file's size checked before it is read, and counts rows while they are used.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import controls, graph, reservoir
from . import files, tables

#: The spectral radius of exported graphs, steps of its estimate, sampled ids, the control's seed.
RADIUS, STEPS, SAMPLED, SHUFFLE_SEED = 0.85, 40, 360, 20260914
#: Names of an export's files.
GRAPH, ANATOMY, SHUFFLED, MANIFEST = "graph.bin", "anatomy.bin", "shuffled.bin", "manifest.json"
#: Digests that a node of a digest tree has under it.
FAN = 256


def shared(spark: SparkSession) -> str:
    """A new path in the shared folder (spark.checkpoint.dir, or the checkpoint folder that was set where it is absent)."""
    reservoir.checkpoint_dir(spark)
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/mossgraph-{uuid.uuid4().hex}"


def read_manifest(path: str) -> dict | None:
    """The manifest of an export, None where there is none."""
    fs, at = files.opened(f"{path}/{MANIFEST}")
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())


def in_two_phases(path: str, build: Callable[[str], dict]) -> dict:
    """The manifest that ``build`` returns for the folder that it fills, which then takes the name ``path``; nothing is left if it fails."""
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    fs, made = files.opened(staging)
    _, target = files.opened(path.rstrip("/"))
    fs.create_dir(made, recursive=True)
    try:
        manifest = build(staging)
        with fs.open_output_stream(f"{made}/{MANIFEST}") as out:
            out.write(json.dumps(manifest, sort_keys=True, indent=1).encode())
        old = f"{target}.old-{uuid.uuid4().hex}"
        there = fs.get_file_info(target).type != pafs.FileType.NotFound
        if there:
            fs.move(target, old)
        fs.move(made, target)
        if there:
            fs.delete_dir(old)
    except BaseException:
        if fs.get_file_info(made).type != pafs.FileType.NotFound:
            fs.delete_dir(made)
        raise
    return manifest


def scale_of(edges: DataFrame, nodes: DataFrame) -> float:
    """The recurrence scale of a graph; an empty or vanishing one has the target radius itself."""
    radius = reservoir.spectral_radius(edges, nodes.select(F.col("idx").alias("node")), STEPS)
    return RADIUS / radius if radius >= 1e-12 else RADIUS


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, about: dict | None = None, bodies: DataFrame | None = None, shuffled: bool = False) -> dict:
    """Publishes a graph and returns its manifest. ``nodes``: idx (from 0), node; ``edges``: src, dst (of idx), w; ``bodies``: idx, body_id, x, y, z, flags.

    The scale of an export that is there already is kept where the graph's digest is the same, and so is its control where no new one is asked for.
    """
    edges, before = reservoir.checkpointed(edges), read_manifest(path) or {}
    n = nodes.count()

    def graph_part(rows: DataFrame, at: str, name: str, old: dict | None) -> dict:
        made = files.save_graph_file(rows, n, f"{at}/{name}")
        scale = old["scale"] if old and old.get("sha256") == made["sha256"] else scale_of(rows, nodes)
        contacts = rows.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        return {"file": name, "neurons": n, "connections": made["edges"], "contacts": contacts, "bytes": made["bytes"], "sha256": made["sha256"], "scale": scale}

    def build(at: str) -> dict:
        manifest = {"about": about or {}, "graph": graph_part(edges, at, GRAPH, before.get("graph")), "anatomy": None, "shuffled": None}
        ids = graph.ordered_digest(nodes.select("idx", "node"), ["idx"], F.col("node").cast("string")).first()
        manifest["graph"]["fingerprint"] = hashlib.sha256(f"{ids[0] if ids else ''}:{manifest['graph']['sha256']}".encode()).hexdigest()
        stride = max(1, n // SAMPLED)
        manifest["graph"]["sample"] = [[r.idx, r.node] for r in nodes.where(F.col("idx") % stride == 0).select("idx", "node").orderBy("idx").collect()]  # 2 * SAMPLED at most
        if bodies is not None:
            made = files.save_anatomy_file(bodies, f"{at}/{ANATOMY}")
            if made["nodes"] != n:
                raise ValueError("bodies and nodes differ in number")
            box = bodies.where(F.col("flags").bitwiseAND(F.lit(files.LOCATED)) > 0).agg(*(f(c).alias(f"{k}_{c}") for c in "xyz" for k, f in (("least", F.min), ("most", F.max)))).first().asDict()
            manifest["anatomy"] = {"file": ANATOMY, "neurons": n, "located": made["located"], "bytes": made["bytes"], "sha256": made["sha256"], "bounds": box}
        if shuffled:
            dealt = reservoir.checkpointed(controls.target_shuffle(edges, SHUFFLE_SEED))
            manifest["shuffled"] = graph_part(dealt, at, SHUFFLED, before.get("shuffled")) | {"seed": SHUFFLE_SEED}
        elif before.get("shuffled"):
            fs, new = files.opened(at)
            _, old = files.opened(path)
            fs.copy_file(f"{old}/{SHUFFLED}", f"{new}/{SHUFFLED}")
            manifest["shuffled"] = before["shuffled"]
        fs, folder = files.opened(at)
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.endswith(".bin.json"):
                fs.delete_file(info.path)  # the manifest has what they say
        return manifest

    return in_two_phases(path, build)


def export_full(spark: SparkSession, source: str, path: str, require_full: bool) -> dict:
    """Publishes a whole export (graph, anatomy, control) from ``source``, each file checked against its digest. An incomplete one is an error if ``require_full``, else a manifest that says so; nothing stands in for what is missing."""
    manifest = read_manifest(source)
    fs, at = files.opened(source)
    parts = {"graph": GRAPH, "anatomy": ANATOMY, "shuffled": SHUFFLED}
    missing = [name for key, name in parts.items() if not (manifest and manifest.get(key)) or fs.get_file_info(f"{at}/{name}").type != pafs.FileType.File]
    if missing:
        if require_full:
            raise FileNotFoundError(f"the export is incomplete: {missing}")
        return in_two_phases(path, lambda _: {"available": False, "missing": missing})

    def build(staging: str) -> dict:
        _, new = files.opened(staging)
        rows = spark.createDataFrame([(f"{at}/{n}", f"{new}/{n}") for n in parts.values()], "a string, b string").repartition(len(parts))
        source_ = source

        def copy(batches):
            for batch in batches:
                fs, _ = files.opened(source_)
                digests = []
                for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out = files.Joined(fs, b)
                    out.copy(a)
                    digests.append(out.close())
                yield batch.from_arrays([batch.column(1), digests], ["b", "sha256"])

        got = {r.b.rsplit("/", 1)[1]: r.sha256 for r in rows.mapInArrow(copy, "b string, sha256 string").collect()}  # three files
        if wrong := [n for key, n in parts.items() if got.get(n) != manifest[key]["sha256"]]:
            raise ValueError(f"the export is damaged: {wrong}")
        return manifest | {"available": True}

    return in_two_phases(path, build)


class Loaded:
    """An export's tables, counted while they are used. ``check`` compares the counts with the manifest after the first action on all of them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        manifest = read_manifest(path)
        if manifest is None or not manifest.get("graph"):
            raise FileNotFoundError(f"no export: {path}")
        self.manifest, self.seen = manifest, {}
        if manifest.get("anatomy") and manifest["anatomy"]["neurons"] != manifest["graph"]["neurons"]:
            raise ValueError("graph and anatomy differ in number")
        part = lambda key: manifest.get(key) or {}
        read = lambda key: tables.binary_graph(spark, f"{path}/{part(key)['file']}", bytes=part(key)["bytes"], scale=part(key)["scale"])
        self.edges = self.counted("graph", read("graph"), F.count("*").alias("connections"), F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)).alias("last"))
        self.bodies = self.counted("anatomy", tables.binary_anatomy(spark, f"{path}/{ANATOMY}"), F.count("*").alias("neurons"), F.count("x").alias("located")) if part("anatomy") else None
        self.shuffled = self.counted("shuffled", read("shuffled"), F.count("*").alias("connections"), F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)).alias("last")) if part("shuffled") else None  # absent: no control, no score

    def counted(self, key: str, rows: DataFrame, *counts) -> DataFrame:
        self.seen[key] = Observation(f"{key}-{uuid.uuid4().hex}")
        return rows.observe(self.seen[key], *counts)

    def check(self) -> dict[str, dict]:
        """The counts of the tables; an error if they aren't the manifest's. No table is read again."""
        got = {key: seen.get for key, seen in self.seen.items()}
        for key, counts in got.items():
            want = self.manifest[key]
            if any(want[name] != v for name, v in counts.items() if name in want) or counts.get("last", -1) >= want["neurons"]:
                raise ValueError(f"{key} isn't what the manifest says: {counts}")
        return got


def chunk_digests(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """path, chunk, bytes, sha256 of all ranges of ``chunk`` bytes of a file or of a folder's files, each range read by one task."""
    return files.registered(spark).read.format("mossgraph_ranges").option("chunk", chunk).load(path)


def text_chunks(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, chunk, sha256 of pieces of ``size`` characters of every text (an empty or null one has a single empty piece)."""
    t = F.coalesce(text, F.lit(""))
    last = F.greatest(F.ceil(F.length(t) / size) - 1, F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.sha2(F.substring(t, k * size + 1, F.lit(size)).cast("binary"), 256))
    return rows.select(key, F.posexplode(pieces).alias("chunk", "sha256"))


def digest_tree(leaves: DataFrame, key: str, fan: int = FAN) -> DataFrame:
    """key, chunks, sha256: the root of a tree over each key's digests (key, chunk, sha256) in order. A node is the digest of up to ``fan`` digests under it, so no task has all of a large file's.

    Appended chunks change only the last node of each level. A single leaf is the root itself.
    """
    now = reservoir.checkpointed(leaves.select(key, F.col("chunk").cast("long").alias("chunk"), "sha256"))
    counts = now.groupBy(key).agg(F.count("*").alias("chunks"))
    most = counts.agg(F.max("chunks")).first()[0] or 0
    while most > 1:
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha256"))), lambda x: x["sha256"]), "")  # fan digests at most
        grouped = now.groupBy(key, F.floor(F.col("chunk") / fan).alias("up")).agg(F.count("*").alias("n"), F.max("sha256").alias("only"), inner.alias("inner"))
        alone = (F.col("n") == 1) & (F.col("up") == 0)
        now = reservoir.checkpointed(grouped.select(key, F.col("up").alias("chunk"), F.when(alone, F.col("only")).otherwise(F.sha2(F.col("inner").cast("binary"), 256)).alias("sha256")))
        most = -(-most // fan)
    return now.select(F.col(key).alias("__k"), "sha256").join(counts, F.col("__k").eqNullSafe(F.col(key))).select(key, "chunks", "sha256")


def verified_chunks(leaves: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """key, chunk, status of every chunk of a file against a manifest of the same columns: ok, changed, missing or stray. The file and the place of what is wrong are named."""
    both = leaves.select(key, "chunk", F.col("sha256").alias("a")).join(manifest.select(key, "chunk", F.col("sha256").alias("b")), [key, "chunk"], "full")
    return both.select(key, "chunk", F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "stray").when(F.col("a") == F.col("b"), "ok").otherwise("changed").alias("status"))
