"""Checks of data and limits on requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def embedding_gate(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: vectors, numbers, non-numbers and the largest magnitude."""
    x = rows.select(key, F.explode(vector).alias("x"))
    v = F.col("x").cast("double")
    return x.agg(F.count_distinct(key).alias("vectors"), F.count("*").alias("numbers"), F.count_if(F.isnan(v)).alias("not_numbers"), F.round(F.max(F.abs(v)), 6).alias("largest"))


def off_unit(rows: DataFrame, key: str, vector: str, slack: float = 1e-3) -> DataFrame:
    """key, norm of vectors whose length isn't 1 within ``slack`` (or isn't a number)."""
    from ..functions.vectors import norm

    n = norm(F.col(vector))
    return rows.select(key, n.alias("norm")).where(~F.coalesce(F.abs(F.col("norm") - 1) <= slack, F.lit(False)) | F.isnan("norm"))


def provenance(rows: DataFrame, key: str, vector: str, manifest: dict) -> DataFrame:
    """The rows, if a manifest's numbers hold: rows, dimensions, the digest of ids and vectors in order, and unit length where it says so. Else an error. No rows agree with a manifest of none."""
    from .graph import ordered_digest

    text = F.concat_ws(":", F.col(key).cast("string"), F.concat_ws(",", F.transform(vector, lambda x: F.format_string("%.6f", x.cast("double")))))
    seen = rows.agg(F.count("*").alias("rows"), F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most")).first()
    if seen["rows"] == manifest["rows"] == 0:
        return rows
    if (seen["rows"], seen["least"], seen["most"]) != (manifest["rows"], manifest["dimensions"], manifest["dimensions"]):
        raise ValueError(f"rows or dimensions differ from the manifest: {seen}")
    if ordered_digest(rows, [key], text).first()["digest"] != manifest["digest"]:
        raise ValueError("the digest differs from the manifest")
    if manifest.get("unit") and not off_unit(rows, key, vector).isEmpty():
        raise ValueError("vectors aren't of unit length")
    return rows


def window_counts(rows: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Rows of the same key in the trailing window, the row itself and its peers included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("in_window", F.count("*").over(w))


def admitted(rows: DataFrame, key: str, row_id: str, ts: str, limit: int, seconds: float) -> DataFrame:
    """row_id, admitted: a row is admitted if fewer than ``limit`` admitted ones of its key lie in the trailing window (refused ones don't count).

    The decision depends on earlier decisions, so each key's rows are walked in order, a bounded queue of ``limit`` times at hand.
    """
    kind = rows.schema[row_id].dataType.simpleString()

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = None, deque()
        for pdf in frames:  # a key's rows may run over many batches; only its last times are carried on
            out = []
            for k, t in zip(pdf[key], pdf[ts], strict=True):
                if k != now:
                    now, recent = k, deque()
                while recent and (t - recent[0]).total_seconds() >= seconds:
                    recent.popleft()
                out.append(len(recent) < limit)
                if out[-1]:
                    recent.append(t)
            yield pd.DataFrame({row_id: pdf[row_id].to_numpy(), "admitted": out})

    dealt = rows.select(key, row_id, ts).repartition(F.col(key)).sortWithinPartitions(key, ts, row_id)
    return dealt.mapInPandas(walk, f"{row_id} {kind}, admitted boolean")


def valid_texts(rows: DataFrame, column: str = "text", most: int = 4000) -> DataFrame:
    """Rows whose trimmed text has 1 to ``most`` characters, trimmed."""
    return rows.withColumn(column, F.trim(column)).where(F.length(column).between(1, most))


def card_checks(cards: DataFrame, key: str, column: str, each: int = 6000, total: int = 120_000) -> DataFrame:
    sums = cards.agg((F.sum(F.length(column)) <= total).alias("total_ok"))
    return cards.select(key, F.length(column).between(1, each).alias("ok")).join(F.broadcast(sums))  # one row is broadcast


def unknown_values(rows: DataFrame, column: str, domain: DataFrame, value: str) -> DataFrame:
    """Rows whose value isn't in the domain."""
    return rows.join(domain.select(F.col(value).alias(column)).distinct(), column, "left_anti")
