"""Writers: graphs, data sets, experiment results and compact exports."""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_graph(nodes: DataFrame, edges: DataFrame, meta: dict, path: str) -> None:
    """Nodes and edges as Parquet (edges bucketed by range of source for pruning), metadata as JSON."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    edges.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def save_splits(rows: DataFrame, path: str, meta: dict | None = None) -> None:
    """JSON lines, a folder for each split; with ``meta``, also that beside the numbers of rows and labels of each split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)
    if meta is not None:
        counts = {r["split"]: {"rows": r["n"], "sensitive": r["s"]} for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if("contains_sensitive").alias("s")).collect()}
        rows.sparkSession.createDataFrame([(json.dumps(meta | {"splits": counts}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_meta")


def save_result(result: dict, path: str, model: str, stamp: str) -> None:
    """One experiment's result, and the model's latest."""
    from pyspark.sql import SparkSession

    row = SparkSession.active().createDataFrame([(json.dumps(result, sort_keys=True),)], "value string").coalesce(1)
    row.write.mode("overwrite").text(f"{path}/experiment_{stamp}")
    row.write.mode("overwrite").text(f"{path}/latest/{model}")


def frozen(choices: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Selections written before the test split is scored, read back, with their digest."""
    choices.write.mode("errorifexists").json(path)
    back = choices.sparkSession.read.schema(choices.schema).json(path)
    rows = back.select(F.to_json(F.struct(*sorted(back.columns))).alias("j")).agg(F.sort_array(F.collect_list("j"))).first()[0]  # a row for each model and seed
    return back, hashlib.sha256("\n".join(rows).encode()).hexdigest()


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Fractions rounded for a public export."""
    return rows.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in rows.schema])


def export_public(rows: DataFrame, path: str) -> None:
    rounded(rows).write.mode("overwrite").option("compression", "gzip").json(path)


#: The order of models in summaries.
MODEL_ORDER = ("connectome", "random_erdos", "random_degree_preserving", "random_weights", "linear", "mlp")


def summary_table(summary: DataFrame) -> DataFrame:
    """Models in their fixed order with mean and deviation as text."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, MODEL_ORDER)), F.col("model")), F.lit(0))
    return summary.select("model", F.format_string("%.4f +- %.4f", "mean", "std_pop").alias("macro_f1"), F.when(place == 0, 99).otherwise(place).alias("place")).orderBy("place", "model").drop("place")


def binary_graph(edges: DataFrame, n: int) -> tuple[bytes, str]:
    """A compressed-row graph file of edges (src, dst, w) between 0 and n - 1, and its digest. The format is one file, so the graph must fit the driver; ``validation.graph_bytes`` tells its size beforehand."""
    from .tables import GRAPH_MAGIC

    rows = edges.select("src", "dst", "w").orderBy("src", "dst").toArrow()
    src = rows.column("src").to_numpy()
    offsets = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]).astype("<u4")
    raw = GRAPH_MAGIC + struct.pack("<II", n, len(src)) + offsets.tobytes() + rows.column("dst").to_numpy().astype("<u4").tobytes() + rows.column("w").to_numpy().astype("<f4").tobytes()
    return raw, hashlib.sha256(raw).hexdigest()


def binary_anatomy(bodies: DataFrame) -> tuple[bytes, str]:
    """An anatomy file of bodies (idx, body_id, x, y, z, flags) in order of idx, and its digest. Missing places have the mark of the format; a flag that claims a missing place is an error."""
    from .tables import ANATOMY_MAGIC, MISSING

    wrong = bodies.where((F.col("flags").bitwiseAND(F.lit(8)) > 0) & (F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()))
    if not wrong.isEmpty():
        raise ValueError("flags claim a missing place")
    rows = bodies.fillna(MISSING, ["x", "y", "z"]).orderBy("idx").select("body_id", "x", "y", "z", "flags").toArrow()
    at = np.column_stack([rows.column(c).to_numpy() for c in "xyz"]).astype("<i4")
    flags = rows.column("flags").to_numpy().astype("u1")
    raw = ANATOMY_MAGIC + struct.pack("<II", len(flags), int((flags & 8 > 0).sum())) + rows.column("body_id").to_numpy().astype("<u4").tobytes() + at.tobytes() + flags.tobytes()
    return raw, hashlib.sha256(raw).hexdigest()


def content_addressed(spark, payload: dict, path: str) -> str:
    """Writes JSON under a name that holds its digest, by a file of another name that is renamed; a second time nothing changes. Returns the name."""
    import uuid

    from .files import opened

    text = json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()
    name = f"{path}/{hashlib.sha256(text).hexdigest()}.json"
    fs, at = opened(name)
    if fs.get_file_info(at).is_file:
        return name
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    made = f"{at}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(made) as out:
        out.write(text)
    fs.move(made, at)
    return name


def publish(spark, path: str, to: str) -> DataFrame:
    """Writes the manifest (name, bytes, sha256) of the files under ``path`` and returns their check against it, read back."""
    from .tables import file_digests, verified

    files = file_digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")
    files.coalesce(1).write.mode("errorifexists").json(to)
    return verified(files, spark.read.schema("name string, bytes long, sha256 string").json(to))
