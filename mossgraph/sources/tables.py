"""Scans: labelled text, graphs, edge lists, results and binary graph files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import ANATOMY_MAGIC, GRAPH_MAGIC, MISSING, REPLAY_MAGIC, registered  # noqa: F401

TEXT = "text string, labels array<string>, contains_sensitive boolean, difficulty string, task string"
#: Data sets in order of preference.
PREFERENCE = ("sensitive_harder", "sensitive_hard", "sensitive")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def labelled_text(spark: SparkSession, root: str, split: str, data_dir: str | None = None) -> DataFrame:
    """A split of JSON lines: of the given folder, else of the first preferred one that has it. A missing difficulty is medium."""
    folders = [data_dir] if data_dir else [f"{root}/{name}" for name in PREFERENCE]
    for folder in folders:
        path = f"{folder}/{split}.jsonl"
        if exists(spark, path):
            rows = spark.read.schema(TEXT).json(path)
            return rows.withColumn("difficulty", F.coalesce("difficulty", F.lit("medium")))
    raise FileNotFoundError(f"no {split} split under {folders}")


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes, edges and metadata of a saved graph."""
    meta = spark.read.json(f"{path}/meta").first()
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), meta.asDict(recursive=True)


def neurons(spark: SparkSession, path: str) -> DataFrame:
    """node, cell_type, instance of a CSV with bodyId, type, instance; blanks are unknown."""
    rows = spark.read.schema("bodyId string, type string, instance string").csv(path, header=True)
    known = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    return rows.where("bodyId IS NOT NULL").select(F.col("bodyId").alias("node"), known(F.col("type")).alias("cell_type"), known(F.col("instance")).alias("instance"))


def connections(spark: SparkSession, path: str, known: DataFrame, least: float = 2.0) -> DataFrame:
    """src, dst, w of a CSV with bodyId_pre, bodyId_post, weight, between known nodes and of enough weight; the weight test is pushed into the scan."""
    rows = spark.read.schema("bodyId_pre string, bodyId_post string, weight double").csv(path, header=True).where(F.col("weight") >= least)
    ends = known.select("node").distinct()
    rows = rows.join(ends, F.col("bodyId_pre") == F.col("node"), "left_semi").join(ends, F.col("bodyId_post") == F.col("node"), "left_semi")
    return rows.select(F.col("bodyId_pre").alias("src"), F.col("bodyId_post").alias("dst"), F.col("weight").alias("w"))


def edge_list(rows: DataFrame, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, idx) numbered as first seen and edges by index, of rows (position, pre_id, post_id, weight); a missing weight is 1. Nodes beyond ``max_nodes`` aren't admitted."""
    from ..operators.controls import numbered

    seen = rows.select(F.explode(F.array(F.struct(F.col("pre_id").alias("node"), (F.col("position") * 2).alias("at")), F.struct(F.col("post_id").alias("node"), (F.col("position") * 2 + 1).alias("at")))).alias("x")).groupBy("x.node").agg(F.min("x.at").alias("at"))
    nodes = numbered(seen, ["at"], "n").select("node", (F.col("n") - 1).alias("idx"))
    if max_nodes is not None:
        nodes = nodes.where(F.col("idx") < max_nodes)
    a, b = nodes.select(F.col("node").alias("pre_id"), F.col("idx").alias("src")), nodes.select(F.col("node").alias("post_id"), F.col("idx").alias("dst"))
    return nodes, rows.join(a, "pre_id").join(b, "post_id").groupBy("src", "dst").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w"))


def resolve(df: DataFrame, names: tuple[str, ...]) -> str:
    """The first of ``names`` among the columns, without regard to case; else a column that holds all its parts."""
    lower = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in lower:
            return lower[name.lower()]
    for name in names:
        for low, c in lower.items():
            if all(part in low for part in name.lower().split("_")):
                return c
    raise KeyError(f"none of {names} among {df.columns}")


def binary_graph(spark: SparkSession, path: str, magic: bytes = GRAPH_MAGIC, positive: bool = True, **options) -> DataFrame:
    """src, dst, w of compressed-row files: magic, nodes, edges, offsets, targets, weights. Wrong sizes, offsets, targets or weights are errors. Large files are read by ranges of rows and edges."""
    return registered(spark).read.format("mossgraph_csr").options(magic=magic.hex(), positive="true" if positive else "false", **options).load(path)


def binary_anatomy(spark: SparkSession, path: str) -> DataFrame:
    """node, body_id, x, y, z, flags of anatomy files; coordinates that are missing or not flagged are null. Large files are read by ranges of bodies."""
    return registered(spark).read.format("mossgraph_anatomy").load(path)


def results(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Result files of the given science version, else one row that says so."""
    rows = spark.read.option("multiLine", True).json(path)
    rows = rows if "science_version" in rows.columns else rows.withColumn("science_version", F.lit(None).cast("string"))
    fit = rows.where(F.col("science_version") == version).select(F.lit("measured").alias("status"), F.to_json(F.struct("*")).alias("result"))
    none = spark.range(1).select(F.lit("not_yet_measured").alias("status"), F.lit(None).cast("string").alias("result"))
    return fit if fit.limit(1).count() else none


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256, md5_base64 of files, for checks against a manifest."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.base64(F.unhex(F.md5("content"))).alias("md5_base64"))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, status of files (name, sha256) against a manifest of the same columns: ok, changed, missing or stray."""
    both = files.select("name", F.col("sha256").alias("a")).join(manifest.select("name", F.col("sha256").alias("b")), "name", "full")
    return both.select("name", F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "stray").when(F.col("a") == F.col("b"), "ok").otherwise("changed").alias("status"))


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """run, model, seed, encoder, macro_f1 of the result files experiment_*, by run."""
    rows = spark.read.option("multiLine", True).schema("model_type string, seed long, encoder string, metrics_test struct<macro_f1: double>").json(f"{path}/experiment_*")
    run = F.regexp_extract(F.input_file_name(), r"(experiment_[^/]+)/[^/]*$", 1)
    return rows.select(run.alias("run"), F.col("model_type").alias("model"), "seed", "encoder", F.col("metrics_test.macro_f1").alias("macro_f1")).orderBy("run")


def feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of Arrow IPC (Feather) files: every file is read by the task that has it, batch by batch."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").first()["content"]  # for the schema only
    schema = pa.ipc.open_file(pa.py_buffer(bytes(first))).schema
    names = columns or schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                reader = pa.ipc.open_file(raw.as_buffer())
                for k in range(reader.num_record_batches):
                    yield reader.get_batch(k).select(names)

    return files.select("content").mapInArrow(run, from_arrow_schema(pa.schema([schema.field(n) for n in names])))
