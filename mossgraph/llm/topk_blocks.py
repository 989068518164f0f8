"""Exact top-k search with block-at-a-time pruning.

Candidates are ordered by id and cut into blocks of consecutive ids. A block keeps the greatest and least value of every
dimension ("term") and its vectors as a forward index. For a query, a block's bound is the sum over terms of what the
query's value can make of them at most. Queries meet blocks in descending order of their bounds, score the block's forward index, and
stop when the next bound is below their k-th score so far; blocks whose bound equals it are still read, for ties.

Scale: candidates are groups of bounded size, each with its own greatest and least values. A query's bounds come from those summaries
alone, a row for each group. It visits the group of its highest bound first; the k-th score found there (of all rows under its
query_id) is then shared: only the groups whose bounds reach it are visited, and there blocks start from that score. Vectors travel
for such visits only, so where bounds prune, work and shuffles fall with them; where they don't, every query meets every group, in blocks.
A group's queries are dealt out by their number, so no task holds more than about ``QUERIES`` of them. A visit returns k rows a query;
a window then merges the lists, of which Spark drops all but k before the shuffle. Groups of candidates are ranges of ids, by a count; a range that holds
more rows than ``CANDIDATES``, as many rows share an id, is dealt out further by row number, so no group grows with the input.
Bounds of summaries are rounded up by more than doubles can err, so rounding never costs a row.

Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id. Vectors of
unequal length are compared over the shorter's components. Scores beyond a long's range count as its nearest end, whatever the
components' size. Repeated rows are candidates each, and queries each under one query_id, of which the k best remain; a query's own id never is a candidate.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK, CANDIDATES, QUERIES, BUNDLE = 256, 16384, 4096, 1024
SCALE = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Products below this bound are exact in float64.
EXACT = 1 << 52


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, ``v``: the components as floor(SCALE * x) / SCALE (exact, as SCALE is a power of two; large doubles stand as they are), and ``row``, a number for each."""
    ok = F.col("vec_id").isNotNull() & F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    cut = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x.cast("double") * SCALE) / SCALE).otherwise(x.cast("double"))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, cut).alias("v"), F.monotonically_increasing_id().alias("row"))


def packed(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as rows, with zeros after the shorter ones."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lens = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), lens.max(initial=0)))
    out[np.arange(out.shape[1])[None, :] < lens[:, None]] = lists.flatten().to_numpy()
    return out


def integers(m: np.ndarray, exact: bool) -> np.ndarray:
    """SCALE times the numbers: as float64, or as Python integers."""
    if exact:
        return m * SCALE
    whole = lambda x: int(x) * SCALE if abs(x) >= 1 << 52 else int(x * SCALE)
    return np.array([[whole(x) for x in r] for r in m.tolist()], object).reshape(m.shape)


def search_cell(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int, block: int = BLOCK, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, candidate id and score of the k best candidates of each query; candidates in ascending order of id. Scores below a query's ``reach`` may be left out."""
    width = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :width], candidates[:, :width]
    top = lambda m: float(np.abs(m).max(initial=0)) * SCALE
    exact = top(queries) * top(candidates) * max(width, 1) < EXACT
    q, c = integers(queries, exact), integers(candidates, exact)
    kind = np.float64 if exact else object
    cuts = np.arange(0, len(ids), block)
    high, low = np.array([c[x : x + block].max(0) for x in cuts], kind), np.array([c[x : x + block].min(0) for x in cuts], kind)
    positive, negative = np.where(q > 0, q, 0), np.where(q > 0, 0, q)
    bounds = positive.dot(high.T) + negative.dot(low.T)
    if not exact:
        bounds = np.minimum(np.maximum(bounds, LEAST), MOST)
    turn = np.argsort(-bounds, axis=1, kind="stable")
    worst = -2 * EXACT if exact else LEAST - 1
    best = np.full((len(q), k), worst, kind)
    who = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    reach = np.full(len(q), worst, kind) if reach is None else np.array([worst if x is None else x for x in reach], kind)
    for r in range(len(cuts)):
        at = turn[:, r]
        live = np.flatnonzero(bounds[np.arange(len(q)), at] >= np.maximum(best[:, -1], reach))
        if not len(live):
            break
        for b in np.unique(at[live]):
            mine = live[at[live] == b]
            own = slice(cuts[b], cuts[b] + block)
            score = q[mine].dot(c[own].T)
            if not exact:
                score = np.minimum(np.maximum(score, LEAST), MOST)
            score[ids[own][None, :] == query_ids[mine][:, None]] = worst
            score = np.concatenate([best[mine], score], 1)
            names = np.concatenate([who[mine], np.where(score[:, k:] == worst, np.iinfo(np.int64).max, ids[own][None, :])], 1)
            order = np.argsort(names, 1, kind="stable")
            score, names = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)
            order = np.argsort(-score, 1, kind="stable")[:, :k]
            best[mine], who[mine] = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)
    found = best != worst
    return np.repeat(query_ids, k).reshape(-1, k)[found], who[found], best[found]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer inner products of each row for which ``is_query`` holds, ties to the smaller vec_id."""
    rows = stored(quantised(vectors, column))
    n, m = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    across, down = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    marks = sorted(set(rows.agg(F.percentile_approx("vec_id", [i / across for i in range(1, across)] or [0.5], 10_000)).first()[0] or [])) if across > 1 else []

    def ranged(first: list[int] | None = None, deals: list[int] | None = None) -> DataFrame:
        """Rows with the number of their range of ids, or of their group in it."""
        cuts = np.array(marks, np.int64)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.searchsorted(cuts, batch.column("vec_id").to_numpy(), side="right")
                if deals:
                    at = np.array(first)[at] + batch.column("row").to_numpy() % np.array(deals)[at]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "c"])

        return rows.mapInArrow(place, "vec_id long, v array<double>, row long, c int")

    counts = dict(ranged().groupBy("c").count().collect())  # a number for each range
    deals = [-(-counts.get(r, 1) // (2 * CANDIDATES)) for r in range(len(marks) + 1)]  # above 1: a range with more rows than a group may have
    first = np.cumsum([0, *deals]).tolist()
    groups = stored(ranged(first, deals))
    summaries = stored(groups.mapInArrow(_extremes, _SUMMARY).groupBy("c").applyInArrow(_merged, _SUMMARY))
    queries = rows.where(is_query).withColumn("q", F.pmod("row", F.lit(down)).cast("int"))

    best = bounded(queries.withColumns({"kth": F.lit(None).cast("long"), "met": F.lit(-1)}), summaries, down, first[-1], _best, "row long, c int, bound double")
    best = best.groupBy("row").agg(F.max(F.struct("bound", (-F.col("c")).alias("c"))).alias("top")).select("row", (-F.col("top")["c"]).alias("c"))
    best = stored(best)
    early = stored(_ranked(visited(best, queries.withColumn("kth", F.lit(None).cast("long")), groups, k), k))
    if first[-1] == 1:
        return early
    kth = early.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    asks = stored(queries.join(kth, "vec_id", "left").join(best.withColumnRenamed("c", "met"), "row"))
    left = stored(bounded(asks, summaries, down, first[-1], _reached, "c int, rows array<long>"))
    late = visited(left.select("c", F.explode("rows").alias("row")), asks, groups, k)
    return _ranked(early.drop("rank").unionByName(late), k)


_SUMMARY = "c int, high array<double>, low array<double>"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _summary(found: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    lists = [pa.array([v[i].tolist() for v in found.values()], pa.list_(pa.float64())) for i in (0, 1)]
    return pa.table([pa.array(list(found), pa.int32()), *lists], ["c", "high", "low"])


def _wider(a: np.ndarray, b: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """Elementwise; what one lacks is zero."""
    width = max(len(a), len(b))
    return pick(np.pad(a, (0, width - len(a))), np.pad(b, (0, width - len(b))))


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greatest and least values of each group in this task."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        v, c = packed(batch.column("v")), batch.column("c").to_numpy()
        for g in np.unique(c).tolist():
            high, low = v[c == g].max(0), v[c == g].min(0)
            old = found.get(g)
            found[g] = (high, low) if old is None else (_wider(old[0], high, np.maximum), _wider(old[1], low, np.minimum))
    yield from _summary(found).to_batches()


def _merged(rows: pa.Table) -> pa.Table:
    return _summary({rows.column("c")[0].as_py(): (packed(rows.column("high")).max(0), packed(rows.column("low")).min(0))})


def bounded(queries: DataFrame, summaries: DataFrame, down: int, across: int, pick, schema: str) -> DataFrame:
    """``pick`` of the bounds of a block of ``queries`` (vec_id, v, row, q, kth, met) in a bundle of summaries."""
    bundles = -(-across // BUNDLE)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    left = queries.select("q", each(bundles).alias("bundle"), "row", "v", "kth", F.col("met").cast("int").alias("c"), none("array<double>").alias("low"))
    right = summaries.select(each(down).alias("q"), F.floor(F.col("c") / BUNDLE).cast("int").alias("bundle"), none("long").alias("row"), F.col("high").alias("v"), none("long").alias("kth"), "c", "low")

    def run(rows: pa.Table) -> pa.Table:
        asks = rows.column("low").is_null().to_numpy()
        asked, held = rows.filter(pa.array(asks)), rows.filter(pa.array(~asks))
        if not asked.num_rows or not held.num_rows:
            return pick(None, None, None, None, None)
        q, high, low = packed(asked.column("v")), packed(held.column("v")), packed(held.column("low"))
        width = min(q.shape[1], high.shape[1])
        q, high, low = q[:, :width], high[:, :width], low[:, :width]
        with np.errstate(all="ignore"):
            most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
            err = 1e-9 * (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T)
            bounds = np.nan_to_num((most + err) * float(SCALE * SCALE), nan=np.inf, posinf=np.inf, neginf=float(LEAST))
        return pick(asked.column("row").to_numpy(), held.column("c").to_numpy(), np.clip(bounds, float(LEAST), float(MOST)), asked.column("kth").to_pylist(), asked.column("c").to_numpy())

    return left.unionByName(right).groupBy("q", "bundle").applyInArrow(run, schema)


def _best(rows, groups, bounds, kth, met) -> pa.Table:
    """Each query's group of the highest bound."""
    at = [] if rows is None else bounds.argmax(1)
    cols = ([], [], []) if rows is None else (rows, groups[at], bounds[np.arange(len(rows)), at])
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64()), strict=True)], ["row", "c", "bound"])


def _reached(rows, groups, bounds, kth, met) -> pa.Table:
    """For each group, the queries whose k-th score its bound reaches, but those that have met it."""
    found: list[tuple[int, np.ndarray]] = []
    if rows is not None:
        need = np.array([-np.inf if x is None else x - 1e-9 * abs(x) for x in kth])
        live = (bounds >= need[:, None]) & (groups[None, :] != met[:, None])
        found = [(g, rows[live[:, j]]) for j, g in enumerate(groups.tolist()) if live[:, j].any()]
    return pa.table([pa.array([g for g, _ in found], pa.int32()), pa.array([r.tolist() for _, r in found], pa.list_(pa.int64()))], ["c", "rows"])


def visited(pairs: DataFrame, queries: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query in every group that it visits (``pairs``: c, row)."""
    load = pairs.groupBy("c").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    asks = pairs.join(load, "c").join(queries.select("row", "vec_id", "v", "kth"), "row").select("c", F.pmod("row", F.col("parts")).cast("int").alias("part"), "vec_id", "v", "kth", F.lit(True).alias("asks"))
    held = groups.join(load, "c").select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v", F.lit(None).cast("long").alias("kth"), F.lit(False).alias("asks"))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        asks = rows.column("asks").to_numpy()
        asked, held = rows.filter(pa.array(asks)), rows.filter(pa.array(~asks)).sort_by("vec_id")
        if asked.num_rows and held.num_rows:
            got = search_cell(asked.column("vec_id").to_numpy(), packed(asked.column("v")), held.column("vec_id").to_numpy(), packed(held.column("v")), k, reach=asked.column("kth").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), pa.array([int(x) for x in got[2].ravel()], pa.int64())], ["query_id", "vec_id", "score"])

    return asks.unionByName(held).groupBy("c", "part").applyInArrow(run, "query_id long, vec_id long, score long")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
