"""Array columns as vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(body, **values: Column) -> Column:
    """``body`` of values that are computed once, however often it uses them."""
    one = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.element_at(F.transform(one, lambda s: body(*[s[k] for k in values])), 1)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.lit(1e-12), F.sqrt(dot(a, a) * dot(b, b)))


def cosine_added_guard(a: Column, b: Column) -> Column:
    """The variant whose guard is added to the denominator."""
    return dot(a, b) / (F.sqrt(dot(a, a) * dot(b, b)) + 1e-12)


def rms(a: Column) -> Column:
    return F.sqrt(dot(a, a) / F.greatest(F.size(a), F.lit(1)))


def unit(a: Column) -> Column:
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))
    return let(lambda v: let(scaled, v=v, n=norm(v)), v=a)


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """The temperature multiplies the scores."""
    shares = lambda e, total: F.transform(e, lambda x: x / total)
    powers = lambda v, top: F.transform(v, lambda x: F.exp((x - top) * temperature))
    summed = lambda e: let(shares, e=e, total=F.aggregate(e, F.lit(0.0), lambda s, x: s + x))
    return let(lambda v: let(summed, e=let(powers, v=v, top=F.array_max(v))), v=scores)


def activation(x: Column, kind: str = "tanh") -> Column:
    if kind not in ("tanh", "relu"):
        raise ValueError(f"unknown activation: {kind}")
    return F.tanh(x) if kind == "tanh" else F.greatest(x, F.lit(0.0))


def display_gain(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x) * 18)


def confidence_band(x: Column) -> Column:
    return F.when(x < 0.4, "low").when(x < 0.7, "medium").otherwise("high")


def projection_matrix(rows: int, columns: int, seed: int = 42) -> np.ndarray:
    """Seeded Gaussian matrix, N(0, 1 / sqrt(rows))."""
    return np.random.default_rng(seed).normal(0, 1 / math.sqrt(rows), (rows, columns))


def projected(vector: Column, matrix: np.ndarray) -> Column:
    """Projection by a small fixed matrix (a literal), then unit length."""
    columns = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in matrix.T])
    return unit(F.transform(columns, lambda c: dot(vector, c)))


def projected_rows(rows: DataFrame, key: str, vector: str, matrix: np.ndarray, name: str) -> DataFrame:
    """``rows``' key and vector with ``name``, the projection by a matrix too wide for literals, at unit length."""
    shared = rows.sparkSession.sparkContext.broadcast(matrix)  # its size doesn't depend on the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(vector).to_pylist(), float).reshape(-1, len(shared.value)) @ shared.value
            size = np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(vector), pa.array((x / np.where(size > 0, size, 1.0)).tolist(), pa.list_(pa.float64()))], [key, vector, name])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInArrow(run, f"{key} {kind}, {vector} array<double>, {name} array<double>")


def direct_drive(vector: Column, steps: int = 12) -> Column:
    return F.array_repeat(vector, steps)


def temporal_drive(vector: Column, size: int, steps: int = 12) -> Column:
    """Steps over near-equal chunks of the vector, each a blend of the whole and the chunk, gated by a sine; without noise."""
    per, extra = divmod(size, steps)

    def step(t: int) -> Column:
        start = t * per + min(t, extra)
        stop = start + per + (t < extra)
        gate = 0.5 + 0.5 * math.sin(2 * math.pi * (t + 1) / (steps + 1))
        return F.transform(vector, lambda x, i: (0.65 * x + F.when((i >= start) & (i < stop), 0.35 * x).otherwise(0.0)) * gate)

    return F.array(*[step(t) for t in range(steps)])
