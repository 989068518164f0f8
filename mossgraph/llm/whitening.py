"""Embedding whitening by QDWH spectral divide-and-conquer.

Entries become whole numbers x = floor(1024 * c) + 100000. One pass over the vectors sums x by dimension, exactly; a second one sums
the products of centred x in every task, and row by row of the covariance across tasks. The covariance is then split: the
polar factor U of covariance - shift * I, by the QR form of the dynamically weighted Halley iteration, gives the spectral
projector (U + I) / 2 of the eigenvalues above the shift; bases of its range and of the rest turn the matrix into two
blocks, which are split in turn until they are single numbers. Only blocks that hold wanted components are split. The
components go to all tasks, and a third pass projects every vector. The covariance of what came out is measured, not inferred.

Scale: the driver holds matrices of d x d numbers, d the vectors' length, however many vectors there are; d is ``WIDEST`` at most,
beyond which an error is raised. Each vector is projected in the task that reads it.

Vectors that are null or hold a null or non-finite entry are left out. Shorter vectors count as followed by zeros. Entries of
which 1024 * c is beyond 2**61 count as that; a deviation beyond a long's range counts as its greatest number. A component whose
eigenvalue is zero up to rounding can't be scaled: its ``whitened`` is null, and it is no part of ``identity_error`` (null if none is left).
Repeated rows count and return each, a null vec_id stays null, vectors without entries have no components and so no rows, an
empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

COMPONENTS, SCALE, OFFSET, WIDEST = 8, 1024, 100_000, 4096
MOST = (1 << 63) - 1
EPS = np.finfo(float).eps


def halley(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix (QDWH). A singular direction keeps a factor below 1."""
    n = len(a)
    size = np.linalg.norm(a)
    if size == 0:
        return np.zeros_like(a)
    x, low, eye = a / size, EPS, np.eye(n)
    for _ in range(40):
        s = low * low
        d = np.cbrt(4 * (1 - s) / (s * s)) if s < 1 else 0.0
        root = np.sqrt(1 + d)
        p = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - s) / (s * root))) / 2  # the three weights of the rational step
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        basis = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))[0]
        new = q / r * x + (p - q / r) / np.sqrt(r) * basis[:n] @ basis[n:].T
        low = min(1.0, low * (p + q * s) / (1 + r * s))
        moved = np.linalg.norm(new - x)
        x = new
        if low >= 1 - 4 * EPS and moved < np.cbrt(EPS) / 100:
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces of a symmetric matrix, greater eigenvalues first; None if it is a multiple of the identity up to rounding."""
    n, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * EPS * max(abs(mean), np.abs(a).max()):
        return None
    draw, best, least = np.random.default_rng(n), None, np.inf
    for off in (0.0, 0.1, -0.1, 0.37, -0.37, 0.83, -0.83, 0.03, -0.03):
        u = halley(a - (mean + off * spread) * np.eye(n))
        u = (u + u.T) / 2
        k = round((n + np.trace(u)) / 2)
        if not 0 < k < n:
            continue
        up = np.linalg.qr((u + np.eye(n)) @ draw.standard_normal((n, k)))[0]
        up = np.linalg.qr((u + np.eye(n)) @ up)[0]
        down = np.linalg.qr((np.eye(n) - u) @ draw.standard_normal((n, n - k)))[0]
        down = (np.eye(n) - u) @ down
        down = np.linalg.qr(down - up @ (up.T @ down))[0]
        left = np.linalg.norm(down.T @ a @ up)  # what the two blocks still share
        if left < least:
            best, least = (up, down), left
        if left <= 4 * n * EPS * np.linalg.norm(a):
            break
    return best


def components(a: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    a = (a + a.T) / 2
    want, todo, found = min(want, len(a)), [np.eye(len(a))], []
    while todo and len(found) < want:  # blocks by falling eigenvalues: the last one is the next
        basis = todo.pop()
        parts = split(basis.T @ a @ basis) if basis.shape[1] > 1 else None
        if parts:
            todo += [np.linalg.qr(basis @ parts[1])[0], np.linalg.qr(basis @ parts[0])[0]]
        else:
            found += list(basis.T)
    vectors = np.array(found[:want]).reshape(want, len(a)).T
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def kept(vectors: DataFrame, column: str) -> DataFrame:
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda x: x.cast("double")).alias("v"))


def whole(batch: pa.RecordBatch, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x of every vector as rows of ``width`` (or of the longest's), and the vectors' lengths."""
    lists = batch.column(batch.schema.get_field_index("v"))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), sizes.max(initial=0) if width is None else width), OFFSET, np.int64)
    far = float(1 << 61)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.clip(np.floor(SCALE * pc.list_flatten(lists).to_numpy(zero_copy_only=False)), -far, far).astype(np.int64) + OFFSET
    return out, sizes


def exact(x: np.ndarray, rows: int) -> np.ndarray:
    """x as it is where sums of ``rows`` of its numbers fit 64 bits, else as Python integers."""
    return x if int(np.abs(x).max(initial=0)) * max(rows, 1) < 1 << 62 else x.astype(object)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors, and the sums of x by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, held = 0, [], []
        for batch in batches:
            x, sizes = whole(batch)
            n += len(x)
            more = x.shape[1] - len(total)
            total, held = total + [0] * more, held + [0] * more
            real = np.arange(x.shape[1])[None, :] < sizes[:, None]
            for i, (s, c) in enumerate(zip(np.where(real, exact(x, len(x)), 0).sum(0).tolist(), real.sum(0).tolist(), strict=True)):
                total[i] += s
                held[i] += c
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([0, *total], pa.decimal128(38, 0)), pa.array([n, *held], pa.int64())], ["i", "total", "held"])

    got = {r.i: (int(r.total), r.held) for r in rows.mapInArrow(run, "i int, total decimal(38,0), held long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("held").alias("held")).collect()}
    n = got.pop(-1, (0, 0))[1]
    return n, [got[i][0] + OFFSET * (n - got[i][1]) for i in sorted(got)]


def products(rows: DataFrame, width: int, centred) -> np.ndarray:
    """The sum of z z' over all rows, z = ``centred`` (a batch's rows as a matrix): a row of the matrix is summed across tasks in one group."""
    fields = "i int, sums array<double>"

    def lists(m: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * width), pa.array(m.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, any_ = np.zeros((width, width)), False
        for batch in batches:
            z = centred(batch)
            m += z.T @ z
            any_ |= len(z) > 0
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), lists(m)], ["i", "sums"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = np.zeros(width)
        for batch in batches:
            row += pc.list_flatten(batch.column(1)).to_numpy().reshape(-1, width).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), lists(row[None, :])], ["i", "sums"])

    out = np.zeros((width, width))
    for r in rows.mapInArrow(run, fields).groupBy("i").applyInArrow(add, fields).collect():
        out[r.i] = r.sums
    return (out + out.T) / 2


def whitened(vectors: DataFrame, column: str = "embedding", want: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector and component."""
    rows = kept(vectors, column)
    n, totals = sums(rows)
    width, shape = len(totals), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return vectors.sparkSession.createDataFrame([], shape)
    if width > WIDEST:
        raise ValueError(f"vectors of {width} entries; {WIDEST} is the most")
    mean = np.array([t / n for t in totals])
    cov = products(rows, width, lambda batch: whole(batch, width)[0] - mean) / n
    values, axes = components(cov, want)
    real = values > width * EPS * max(values[0], np.abs(cov).max())
    scaled = np.where(real, axes / np.sqrt(np.where(real, values, 1)), 0)
    count, reach = len(values), max(map(abs, totals))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch, width)[0]
            z = (x - mean) @ scaled
            far = n * int(np.abs(x).max(initial=0)) + reach
            off = (n * x - np.array(totals)) if far < 1 << 62 else n * x.astype(object) - np.array(totals, object)
            top = int(np.abs(off).max(initial=0))
            off = off if width * top * top <= MOST else off.astype(object)
            deviation = [min(int(s), MOST) for s in (off * off).sum(1)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * count), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "w"])

    done = stored(rows.mapInArrow(project, "vec_id long, deviation long, w array<double>"))
    middle = np.array(done.agg(*(F.avg(F.col("w")[i]) for i in range(count))).first(), float)
    seen = products(done, count, lambda batch: pc.list_flatten(batch.column(2)).to_numpy().reshape(-1, count) - middle) / n
    error = float(np.abs(seen[np.ix_(real, real)] - np.eye(real.sum())).max()) if real.any() else None
    share = [max(float(e), 0.0) / float(np.trace(cov)) if np.trace(cov) > 0 else 0.0 for e in values]
    each = done.select("vec_id", "deviation", F.posexplode("w").alias("at", "z"))
    good, shares = F.array(*(F.lit(bool(r)) for r in real)), F.array(*map(F.lit, share))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(good[F.col("at")], F.col("z")).alias("whitened"), shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
