"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed into ``2 ** bits`` rows of a learned matrix; a document is the mean of its rows,
and a softmax layer over two classes gives its score. The matrix and the layer are trained on the driver by mini-batch
stochastic gradient descent in numpy, on at most ``sample`` labelled documents of each class and ``chars`` code points
(those with the smallest hash of their id): a fit on a bounded sample, its bounds being those parameters. Losses are weighted so that the sample's
classes count as in all training labels. As the layer is linear, scoring needs one number for each hashed row, so what
is broadcast has ``2 ** bits`` floats at any size of the input.

Whole texts are read, in slices of ``SLICE`` code points for bounded memory; n-grams run across the slices' ends, words
longer than a slice are hashed in parts. Null texts score as empty ones, by the bias alone; rows with a null doc_id are
scored like others and count as not held out. Null labels are left out, repeated rows are scored each, an empty table gives an empty result and without labels every score is 0.5. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, hand_back, mix64, remainder, spans, spare

SIZES = (3, 4)
SLICE = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i below n."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class WordHasher:
    """64-bit hashes of ranges of a number array, all at once: differences of a running polynomial sum, then scrambled."""

    def __init__(self) -> None:
        self.up, self.down = powers(1024)

    def __call__(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix64(self.sums(codes, starts, stops))

    def sums(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The ranges' polynomials before they are scrambled: that of a range in two parts is the first's plus ``BASE`` to the power of its length times the second's."""
        if len(codes) > len(self.up):
            self.up, self.down = powers(len(codes) * 5 // 4)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], out=sums[1:])
        return (sums[stops] - sums[starts]) * self.down[starts]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ranges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


class Features:
    """Hashed features of joined texts: for each kind, the slots and the positions at which they start."""

    def __init__(self, bits: int) -> None:
        self.bits, self.words = bits, WordHasher()

    def kinds(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(length, slots, starts); starts is None where there is a slot at every position. Length 0: words."""
        for n in SIZES:
            if len(codes) >= n:
                m = len(codes) - n + 1
                h = np.full(m, np.uint32(n * 0x01000193), np.uint32)
                for j in range(n):
                    h += codes[j : j + m] * _MULTIPLIERS[j]
                    h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                h >>= np.uint32(32 - self.bits)
                yield n, h, None
        starts, stops = ranges((codes != 32) & ((codes < 9) | (codes > 13)))
        if len(starts):
            yield 0, (self.words(codes, starts, stops) >> np.uint64(64 - self.bits)).astype(np.uint32), starts


def pieces(text: str) -> Iterator[tuple[str, int]]:
    """Slices of a text, with the number of leading code points that are there for n-grams only."""
    lead = max(SIZES) - 1
    for at in range(0, max(len(text), 1), SLICE):
        yield text[max(0, at - lead) : at + SLICE], min(at, lead)


@dataclass(frozen=True)
class Model:
    """Weights of hashed slots for the mean, and the bias, in log odds of class 1."""

    bits: int
    weights: np.ndarray
    bias: float

    def scorer(self):
        features, weights = Features(self.bits), self.weights

        def sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """For texts of a slice at most each: sums of weights and numbers of features."""
            codes = code_points("\n".join(texts))
            ends = np.cumsum([len(t) + 1 for t in texts]) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            total, count = np.zeros(len(texts)), np.zeros(len(texts))
            for n, slots, starts in features.kinds(codes):
                run = np.concatenate(([0.0], np.cumsum(weights[slots], dtype=np.float64)))
                if starts is None:
                    lo = np.minimum(begins, len(slots))
                    hi = np.maximum(np.minimum(ends - n + 1, len(slots)), lo)
                else:
                    lo, hi = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
                total += run[hi] - run[lo]
                count += hi - lo
            return total, count

        def score(texts: list[str]) -> np.ndarray:
            out = np.empty(len(texts))
            for a, b in spans([len(t) for t in texts], SLICE):
                if b - a == 1 and len(texts[a]) > SLICE:
                    total = count = 0.0
                    for piece, lead in pieces(texts[a]):
                        x, n = sums([piece])
                        y, m = sums([piece[:lead]]) if lead else (0.0, 0.0)  # counted with the slice before
                        total, count = total + (x - y).sum(), count + (n - m).sum()
                    out[a] = total / max(count, 1)
                else:
                    total, count = sums(texts[a:b])
                    out[a:b] = total / np.maximum(count, 1)
            return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))

        return score


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], share: float, bits: int, dim: int = 8, epochs: int = 12, rate: float = 2.0, batch: int = 16, seed: int = 7) -> Model:
    """``rows``: label, slots, and weights that sum to 1. ``share``: that of label 1 among all training labels."""
    labels = np.array([r[0] for r in rows], int)
    if len(rows) == 0:
        return Model(bits, np.zeros(1 << bits, np.float32), 0.0)
    if labels.min() == labels.max():
        return Model(bits, np.zeros(1 << bits, np.float32), 3.0 if labels[0] else -3.0)
    rng = np.random.default_rng(seed)
    v = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    w, b = np.zeros((2, dim)), np.zeros(2)
    counts = np.bincount(labels, minlength=2)
    weigh = np.array([1 - share, share]) * len(rows) / counts
    steps, step = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            lens = np.array([len(r[1]) for r in part])
            keep = lens > 0
            y = labels[order[at : at + batch]]
            slots, x = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part])
            doc = np.repeat(np.arange(len(part)), lens)
            h = np.zeros((len(part), dim))
            if len(slots):
                h[keep] = np.add.reduceat(v[slots] * x[:, None], (np.cumsum(lens) - lens)[keep])
            z = h @ w.T + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y] -= 1
            p *= (weigh[y] / len(part))[:, None]
            lr = rate * (1 - step / steps)
            grad = (p @ w)[doc] * x[:, None] * (len(part) * lr)
            w -= lr * (p.T @ h)
            b -= 0.1 * lr * p.sum(0)
            np.subtract.at(v.reshape(-1), (slots[:, None].astype(np.int64) * dim + np.arange(dim)).ravel(), grad.ravel().astype(np.float32))
            step += 1
    return Model(bits, (v @ (w[1] - w[0])).astype(np.float32), float(b[1] - b[0]))


def labelled_sample(labels: DataFrame, documents: DataFrame, label: str, fold: int, held_out: int, sample: int, chars: int) -> tuple[DataFrame, float]:
    """y and text of up to ``sample`` labelled documents of each class outside the held-out fold, with ``chars`` / 2 code points at most in each class, and the share of class 1 among all such labels.

    Documents are taken in the order of a hash of their id, without those that would exceed the code points left. Of rows with one doc_id the text of the least hash stands for it.
    """
    rows = labels.where((remainder("doc_id", fold) != held_out) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    share = rows.agg(F.avg("y")).first()[0]
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [rows.where(F.col("y") == y).distinct().orderBy(*order).limit(sample) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionAll(parts[1]))  # 2 * sample rows of two numbers at most
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.select("doc_id", F.length("text").alias("n")).join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.max("n").alias("n")).select("*", order[0].alias("h")).collect()  # a row for each chosen one
    kept, left = [], [chars // 2, chars // 2]
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            kept.append((r["doc_id"], r["y"]))
    few = F.broadcast(documents.sparkSession.createDataFrame(kept, chosen.schema))
    one = texts.join(few, "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select("y", "text"), 0.5 if share is None else share


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 5, held_out: int = 0, sample: int = 1500, chars: int = 1 << 25, bits: int = 17) -> Model:
    """A model of ``labels``.``label``, from rows whose crc32(doc_id as text) mod ``fold`` is not ``held_out``."""
    rows, share = labelled_sample(labels, documents, label, fold, held_out, sample, chars)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                count = np.zeros(1 << bits, np.float32)
                for piece, lead in pieces(text):
                    for part, sign in ((piece, 1), (piece[:lead], -1)):
                        for _, slots, _ in features.kinds(code_points(part)):
                            count += sign * np.bincount(slots, minlength=1 << bits).astype(np.float32)
                slots = np.flatnonzero(count > 0).astype(np.uint32)
                out.append((slots.tobytes(), (count[slots] / max(count[slots].sum(), 1)).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["y", "slots", "x"])

    got = rows.mapInArrow(frugal(hashed), "y int, slots binary, x binary").toArrow()
    data = sorted(zip(got.column("y").to_pylist(), got.column("slots").to_pylist(), got.column("x").to_pylist(), strict=True))
    del got  # the driver holds the sample once
    model = train([(y, np.frombuffer(s, np.uint32), np.frombuffer(x, np.float32)) for y, s, x in data], share, bits)
    del data
    hand_back()
    return model


def score(documents: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``columns`` of every document and its score for class 1 as ``name``, from its text alone."""
    body = spare([*columns, name], "__text")
    kept = documents.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias(body))
    schema = kept.select(*columns).schema.add(name, "double")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            got = scorer(batch.column(body).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(got)], [*columns, name])

    return kept.mapInArrow(frugal(run), schema)


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(documents, fit(documents, labels, **options))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """All columns of the documents that score ``threshold`` or more."""
    columns = tuple(documents.columns)
    name = spare(columns, "__score")
    return score(documents, fit(documents, labels, **options), columns, name).where(F.col(name) >= threshold).select(*columns)
