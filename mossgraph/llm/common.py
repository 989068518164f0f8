"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table  # noqa: F401  (for the operators' queries)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a folder of this machine only where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="mossgraph-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table written in the shared folder: lineage ends here, and a lost executor costs no recomputation of it. Deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mossgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` as a table, written before ``old`` (a table of ``stored`` that nothing else reads) is deleted: for iterations."""
    out = stored(new)
    for where in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
        _delete(old.sparkSession, where)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session has ended before
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def spare(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores after it until it is none of ``columns`` (letter case doesn't count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def remainder(doc_id: str | Column, k: int) -> Column:
    """crc32(doc_id as text) mod k, by which folds are fixed."""
    return F.pmod(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")), F.lit(k))


def spans(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to ``limit`` at most (a larger row stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text that a Python worker takes up at once (a longer text comes alone).
PORTION = 2 << 20


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the values of their largest string or binary column sum to ``PORTION`` bytes at most."""
    for batch in batches:
        wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type)]
        if not wide or batch.num_rows == 0:
            yield batch
        else:
            for a, b in spans(pc.fill_null(pc.binary_length(max(wide, key=lambda c: c.nbytes)), 0).to_pylist(), PORTION):
                yield batch.slice(a, b - a)


def hand_back() -> None:
    """Gives memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def frugal(run: Callable) -> Callable:
    """A function for mapInArrow that takes its batches in portions and hands its memory back when a task ends, as Python workers live on for the next one."""

    @functools.wraps(run)
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(portions(batches))
        finally:
            hand_back()

    return bounded
