"""Binary files as Spark data sources: read by byte ranges, written part by part and committed as a whole.

``mossgraph_csr`` are compressed-row graphs (src, dst, w), ``mossgraph_anatomy`` positions of bodies, ``mossgraph_ranges`` digests
of byte ranges of any files, ``mossgraph_bundle`` files of given content. Readers plan ranges from a few bytes (header, sizes and
some offsets), so one large file is many tasks, each of which checks what it reads. Writers' tasks write parts to a staging
folder beside the target, under names of their own; a commit puts the parts of the tasks that count together in streams, and renames
the result. A failed write leaves no target and no staging folder.

Files are opened by Arrow's file systems (local and shared folders, HDFS, object stores), in the tasks.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: First bytes of the binary files, the mark of a missing place, the bit of a located body, bounds of a recurrence scale.
GRAPH_MAGIC, ANATOMY_MAGIC, REPLAY_MAGIC = b"LFLYMC1\x00", b"LFLYAN1\x00", b"LFDREAM1"
MISSING, LOCATED, MOST_SCALE = -(1 << 31), 8, 10.0
#: Rows of a graph, edges, bodies and bytes that a task reads; edges in a batch; bytes copied at once.
ROWS, EDGES, BODIES, BYTES, BATCH, COPY = 1 << 16, 1 << 20, 1 << 18, 64 << 20, 1 << 17, 8 << 20
HEAD = 16


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def files_at(path: str) -> list[tuple[str, int]]:
    """Paths (with their file system's scheme) and sizes of a file, or of the files in a folder, by name."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = sorted((f for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
    return [(path.rstrip("/") + f.path[len(at.rstrip("/")) :], f.size) for f in found]


def exactly(f: pa.NativeFile, n: int, at: int) -> bytes:
    got = f.read_at(n, at)
    if len(got) != n:
        raise ValueError("the file ends too early")
    return got


@dataclass
class Range(InputPartition):
    """A range of rows (or bodies, or bytes) of a file, and of a graph's edges in it."""

    path: str
    first: int
    last: int
    n: int
    m: int = 0
    start: int = 0
    stop: int = 0


class GraphReader(DataSourceReader):
    """Options: ``magic`` (hex), ``positive`` (weights must be), ``scale`` (a recurrence scale to check), ``bytes`` (the declared size)."""

    def __init__(self, options: dict) -> None:
        self.path, self.magic, self.positive = options["path"], bytes.fromhex(options.get("magic", GRAPH_MAGIC.hex())), options.get("positive", "true") == "true"
        if "scale" in options and not 0 < float(options["scale"]) <= MOST_SCALE:
            raise ValueError("wrong recurrence scale")
        self.declared = int(options["bytes"]) if "bytes" in options else None

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files_at(self.path):
            fs, at = opened(path)
            with fs.open_input_file(at) as f:
                head = f.read_at(HEAD, 0)
                if len(head) < HEAD or head[:8] != self.magic:
                    raise ValueError("not a graph file")
                n, m = struct.unpack_from("<II", head, 8)
                if size != HEAD + 4 * (n + 1) + 8 * m or self.declared not in (None, size):
                    raise ValueError("sizes don't match")
                rows = [*range(0, n, ROWS), n] if n else [0, 0]
                marks = [struct.unpack("<I", exactly(f, 4, HEAD + 4 * r))[0] for r in rows]
            if marks[0] != 0 or marks[-1] != m or any(a > b for a, b in zip(marks, marks[1:], strict=False)):
                raise ValueError("wrong offsets")
            for first, last, a, b in zip(rows, rows[1:], marks, marks[1:], strict=False):
                cuts = [*range(a, b, EDGES), b] if b > a else [a, b]  # rows of many edges are cut among them
                out += [Range(path, first, last, n, m, s, e) for s, e in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, at = opened(part.path)
        base = HEAD + 4 * (part.n + 1)
        with fs.open_input_file(at) as f:
            offsets = np.frombuffer(exactly(f, 4 * (part.last - part.first + 1), HEAD + 4 * part.first), "<u4").astype(np.int64)
            if (np.diff(offsets) < 0).any():
                raise ValueError("wrong offsets")
            for a in range(part.start, part.stop, BATCH):
                k = min(BATCH, part.stop - a)
                dst = np.frombuffer(exactly(f, 4 * k, base + 4 * a), "<u4")
                w = np.frombuffer(exactly(f, 4 * k, base + 4 * part.m + 4 * a), "<f4")
                if (dst >= part.n).any() or not np.isfinite(w).all() or (self.positive and (w <= 0).any()):
                    raise ValueError("wrong connections")
                src = part.first + np.searchsorted(offsets, np.arange(a, a + k), side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int64)), pa.array(dst.astype(np.int64)), pa.array(w.astype(float))], ["src", "dst", "w"])


class AnatomyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files_at(self.path):
            fs, at = opened(path)
            with fs.open_input_file(at) as f:
                head = f.read_at(HEAD, 0)
            if len(head) < HEAD or head[:8] != ANATOMY_MAGIC:
                raise ValueError("not an anatomy file")
            n, located = struct.unpack_from("<II", head, 8)
            if size != HEAD + 17 * n or located > n:
                raise ValueError("sizes don't match")
            cuts = [*range(0, n, BODIES), n] if n else [0, 0]
            out += [Range(path, a, b, n) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, at = opened(part.path)
        a, k, n = part.first, part.last - part.first, part.n
        with fs.open_input_file(at) as f:
            ids = np.frombuffer(exactly(f, 4 * k, HEAD + 4 * a), "<u4")
            xyz = np.frombuffer(exactly(f, 12 * k, HEAD + 4 * n + 12 * a), "<i4").reshape(k, 3)
            flags = np.frombuffer(exactly(f, k, HEAD + 16 * n + a), "u1")
        gone = (flags & LOCATED == 0) | (xyz == MISSING).any(1)
        places = (pa.array(xyz[:, c].astype(np.int64), mask=gone) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + k)), pa.array(ids.astype(np.int64)), *places, pa.array(flags.astype(np.int32))], ["node", "body_id", "x", "y", "z", "flags"])


class RangesReader(DataSourceReader):
    """Option ``chunk``: bytes of a range."""

    def __init__(self, options: dict) -> None:
        self.path, self.chunk = options["path"], int(options.get("chunk", 1 << 20))

    def partitions(self) -> list[Range]:
        step = max(1, BYTES // self.chunk) * self.chunk
        return [Range(path, a, min(size, a + step), size) for path, size in files_at(self.path) for a in (range(0, size, step) if size else [0])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, at = opened(part.path)
        with fs.open_input_file(at) as f:
            rows = []
            for a in range(part.first, max(part.last, part.first + 1), self.chunk):
                raw = exactly(f, min(self.chunk, part.last - a), a)
                rows.append((part.path, a // self.chunk, len(raw), hashlib.sha256(raw).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "chunk", "bytes", "sha256"])


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: a prefix in the staging folder, the first and last places, the number of rows, and more."""

    at: str = ""
    first: tuple = ()
    last: tuple = ()
    rows: int = 0
    more: tuple = ()


class Staged(DataSourceArrowWriter):
    """A staging folder beside the target."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        fs, at = opened(self.path)
        if not overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound:
            raise FileExistsError(self.path)

    def place(self) -> tuple[pafs.FileSystem, str]:
        """A prefix in the staging folder that no other attempt has."""
        fs, at = opened(self.staging)
        fs.create_dir(at, recursive=True)
        return fs, f"{at}/{uuid.uuid4().hex}"

    def published(self, fs: pafs.FileSystem, made: str) -> None:
        """The made file or folder takes the target's name; the staging folder goes."""
        _, target = opened(self.path)
        there = fs.get_file_info(target)
        if there.type == pafs.FileType.Directory:
            fs.delete_dir(target)
        elif there.type == pafs.FileType.File and fs.get_file_info(made).type == pafs.FileType.Directory:
            fs.delete_file(target)
        fs.move(made, target)
        self.cleared()

    def cleared(self) -> None:
        fs, at = opened(self.staging)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)

    def abort(self, messages: list) -> None:
        self.cleared()

    def commit(self, messages: list) -> None:
        try:
            self.committed([m for m in messages if m is not None and m.rows])
        except BaseException:
            self.cleared()
            raise

    def committed(self, parts: list[Part]) -> None:
        raise NotImplementedError


class Joined:
    """A file that is written from start to end, with its digest."""

    def __init__(self, fs: pafs.FileSystem, at: str) -> None:
        self.fs, self.out, self.sha, self.bytes = fs, fs.open_output_stream(at), hashlib.sha256(), 0

    def add(self, raw: bytes) -> None:
        self.out.write(raw)
        self.sha.update(raw)
        self.bytes += len(raw)

    def copy(self, at: str) -> None:
        with self.fs.open_input_stream(at) as f:
            while raw := f.read(COPY):
                self.add(raw)

    def close(self) -> str:
        self.out.close()
        return self.sha.hexdigest()


def in_order(parts: list[Part]) -> list[Part]:
    parts = sorted(parts, key=lambda p: p.first)
    if any(a.last > b.first for a, b in zip(parts, parts[1:], strict=False)):
        raise ValueError("parts overlap")
    return parts


class GraphWriter(Staged):
    """Rows src, dst, w, sorted within tasks whose ranges don't overlap. Options: ``nodes``, ``magic`` (hex). Beside the file stands ``.json`` with its numbers and digest."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.n, self.magic = int(options["nodes"]), bytes.fromhex(options.get("magic", GRAPH_MAGIC.hex()))
        if not 0 <= self.n < 1 << 32:
            raise ValueError("nodes out of range")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        fs, at = self.place()
        first, last, rows = (), (), 0
        with fs.open_output_stream(f"{at}.dst") as out_dst, fs.open_output_stream(f"{at}.w") as out_w, fs.open_output_stream(f"{at}.counts") as out_counts:
            for batch in batches:
                if not batch.num_rows:
                    continue
                src, dst, w = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("src", "dst", "w"))
                if min(src.min(), dst.min()) < 0 or max(src.max(), dst.max()) >= self.n or not np.isfinite(w.astype("<f4")).all():
                    raise ValueError("wrong connections")
                begin = (int(src[0]), int(dst[0]))
                if (np.diff(src) < 0).any() or ((np.diff(src) == 0) & (np.diff(dst) < 0)).any() or (rows and begin < last):
                    raise ValueError("rows out of order")
                first, last, rows = first or begin, (int(src[-1]), int(dst[-1])), rows + len(src)
                out_dst.write(dst.astype("<u4").tobytes())
                out_w.write(w.astype("<f4").tobytes())
                out_counts.write(np.column_stack(np.unique(src, return_counts=True)).astype("<i8").tobytes())
        return Part(at, first, last, rows)

    def offsets(self, fs: pafs.FileSystem, parts: list[Part]) -> Iterator[bytes]:
        """The offsets, from the parts' counts in order: row after row, in pieces."""
        total, node = 0, 0
        yield struct.pack("<I", 0)
        for part in parts:
            with fs.open_input_stream(f"{part.at}.counts") as f:
                while raw := f.read(COPY):
                    for src, count in np.frombuffer(raw, "<i8").reshape(-1, 2).tolist():
                        while node < src:  # rows before this one end where it begins
                            k = min(src - node, 1 << 20)
                            yield np.full(k, total, "<u4").tobytes()
                            node += k
                        total += count
        while node < self.n:
            k = min(self.n - node, 1 << 20)
            yield np.full(k, total, "<u4").tobytes()
            node += k

    def committed(self, parts: list[Part]) -> None:
        parts, m = in_order(parts), sum(p.rows for p in parts)
        if m >= 1 << 32:
            raise ValueError("edges out of range")
        fs, at = self.place()
        out = Joined(fs, at)
        out.add(self.magic + struct.pack("<II", self.n, m))
        waiting, size = [], 0
        for piece in self.offsets(fs, parts):
            waiting.append(piece)
            size += len(piece)
            if size > COPY:
                out.add(b"".join(waiting))
                waiting, size = [], 0
        out.add(b"".join(waiting))
        for kind in ("dst", "w"):
            for part in parts:
                out.copy(f"{part.at}.{kind}")
        noted(fs, self.path, {"nodes": self.n, "edges": m, "sha256": out.close(), "bytes": out.bytes})
        self.published(fs, at)


class AnatomyWriter(Staged):
    """Rows idx, body_id, x, y, z, flags, sorted within tasks, idx from 0 without gaps."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        fs, at = self.place()
        first, last, rows, located = (), (), 0, 0
        with fs.open_output_stream(f"{at}.ids") as out_ids, fs.open_output_stream(f"{at}.xyz") as out_xyz, fs.open_output_stream(f"{at}.flags") as out_flags:
            for batch in batches:
                if not batch.num_rows:
                    continue
                get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
                idx, ids, flags = (get(c).to_numpy(zero_copy_only=False) for c in ("idx", "body_id", "flags"))
                gone = np.any([get(c).is_null().to_numpy(zero_copy_only=False) for c in "xyz"], axis=0)
                if (np.diff(idx) != 1).any() or (rows and idx[0] != last[0] + 1):
                    raise ValueError("places out of order")
                if (gone & (flags & LOCATED > 0)).any():
                    raise ValueError("flags claim a missing place")
                xyz = np.column_stack([get(c).fill_null(MISSING).to_numpy(zero_copy_only=False) for c in "xyz"])
                first, last, rows = first or (int(idx[0]),), (int(idx[-1]),), rows + len(idx)
                located += int((flags & LOCATED > 0).sum())
                out_ids.write(ids.astype("<u4").tobytes())
                out_xyz.write(xyz.astype("<i4").tobytes())
                out_flags.write(flags.astype("u1").tobytes())
        return Part(at, first, last, rows, (located,))

    def committed(self, parts: list[Part]) -> None:
        parts, fs_at = in_order(parts), self.place()
        if any(p.first[0] != at for p, at in zip(parts, np.cumsum([0, *(p.rows for p in parts)]), strict=False)):
            raise ValueError("places out of order")
        fs, at = fs_at
        out = Joined(fs, at)
        n, located = sum(p.rows for p in parts), sum(p.more[0] for p in parts)
        out.add(ANATOMY_MAGIC + struct.pack("<II", n, located))
        for kind in ("ids", "xyz", "flags"):
            for part in parts:
                out.copy(f"{part.at}.{kind}")
        noted(fs, self.path, {"nodes": n, "located": located, "sha256": out.close(), "bytes": out.bytes})
        self.published(fs, at)


class BundleWriter(Staged):
    """Rows name, content: a folder of files with a manifest, all of it or nothing. Digests are computed in the tasks.

    Option ``expect``: JSON of the names that there must be, with their digests or null; anything missing, stray, twice or different fails.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.expect = json.loads(options["expect"]) if "expect" in options else None

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        fs, at = self.place()
        fs.create_dir(at)
        files = []
        for batch in batches:
            for name, content in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "content")), strict=True):
                if not name or "/" in name or name.startswith((".", "_")) or name == "manifest.json":
                    raise ValueError(f"not a name: {name}")
                raw = content or b""
                with fs.open_output_stream(f"{at}/{len(files)}") as out:
                    out.write(raw)
                files.append((name, len(raw), hashlib.sha256(raw).hexdigest(), f"{at}/{len(files)}"))
        return Part(at, rows=len(files), more=tuple(files))

    def committed(self, parts: list[Part]) -> None:
        files = sorted(f for p in parts for f in p.more)
        names = [f[0] for f in files]
        if len(set(names)) != len(names):
            raise ValueError("a name comes twice")
        if self.expect is not None:
            if set(names) != set(self.expect):
                raise ValueError(f"missing: {sorted(set(self.expect) - set(names))}, stray: {sorted(set(names) - set(self.expect))}")
            if wrong := [n for n, _, sha, _ in files if self.expect[n] not in (None, sha)]:
                raise ValueError(f"other content: {wrong}")
        fs, at = self.place()
        fs.create_dir(at)
        for name, _, _, where in files:
            fs.move(where, f"{at}/{name}")
        with fs.open_output_stream(f"{at}/manifest.json") as out:
            out.write(json.dumps({"files": [{"name": n, "bytes": b, "sha256": s} for n, b, s, _ in files]}, sort_keys=True).encode())
        self.published(fs, at)


def noted(fs: pafs.FileSystem, path: str, about: dict) -> None:
    """Numbers and digest of a file, in a file beside it, renamed into its place."""
    _, at = opened(path)
    with fs.open_output_stream(f"{at}.json.tmp") as out:
        out.write(json.dumps(about, sort_keys=True).encode())
    fs.move(f"{at}.json.tmp", f"{at}.json")


def about(path: str) -> dict:
    """What stands beside a written file."""
    fs, at = opened(path)
    with fs.open_input_stream(f"{at}.json") as f:
        return json.loads(f.read())


class Graphs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mossgraph_csr"

    def schema(self) -> str:
        return "src long, dst long, w double"

    def reader(self, schema) -> DataSourceReader:
        return GraphReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return GraphWriter(dict(self.options), overwrite)


class Anatomies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mossgraph_anatomy"

    def schema(self) -> str:
        return "node long, body_id long, x long, y long, z long, flags int"

    def reader(self, schema) -> DataSourceReader:
        return AnatomyReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return AnatomyWriter(dict(self.options), overwrite)


class Ranges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mossgraph_ranges"

    def schema(self) -> str:
        return "path string, chunk long, bytes long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return RangesReader(dict(self.options))


class Bundles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mossgraph_bundle"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BundleWriter(dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the data sources."""
    for source in (Graphs, Anatomies, Ranges, Bundles):
        spark.dataSource.register(source)
    return spark


def save_graph_file(edges: DataFrame, nodes: int, path: str, magic: bytes = GRAPH_MAGIC) -> dict:
    """Writes edges (src, dst, w) between 0 and nodes - 1 as one file, and returns its numbers and digest."""
    registered(edges.sparkSession)
    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"))
    rows.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.format("mossgraph_csr").mode("overwrite").options(nodes=nodes, magic=magic.hex()).save(path)
    return about(path)


def save_anatomy_file(bodies: DataFrame, path: str) -> dict:
    """Writes bodies (idx, body_id, x, y, z, flags) as one file, and returns its numbers and digest."""
    registered(bodies.sparkSession)
    rows = bodies.select(*(F.col(c).cast("long").alias(c) for c in ("idx", "body_id", "x", "y", "z")), F.col("flags").cast("int").alias("flags"))
    rows.repartitionByRange("idx").sortWithinPartitions("idx").write.format("mossgraph_anatomy").mode("overwrite").save(path)
    return about(path)


def save_bundle(files: DataFrame, path: str, expect: dict[str, str | None] | None = None, overwrite: bool = False) -> dict:
    """Publishes files (name, content) and their manifest as a folder, and returns the manifest."""
    registered(files.sparkSession)
    out = files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).write.format("mossgraph_bundle").mode("overwrite" if overwrite else "append")
    (out if expect is None else out.option("expect", json.dumps(expect))).save(path)
    fs, at = opened(path)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())
