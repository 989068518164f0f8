"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a document are the distinct hashed words (whole, and cut to stems of 4 to 6 bytes, as inflected words share
little else), adjacent word pairs and pairs with one word between them, of the lower-cased text; words are runs of ASCII
letters, digits and non-ASCII characters. The learner visits documents one at
a time; every coordinate has its own rate, and the L1 term keeps a weight at zero until its evidence exceeds it, so the
result is a short sorted list of slots and weights, of at most ``2 ** bits`` entries, which is what is broadcast.

It is fitted on at most ``sample`` labelled documents of each class and ``chars`` code points (those with the smallest
hash of their id), bounds given by those parameters, and its losses weigh both classes alike. Fitting and
scoring read whole texts, long ones in slices of ``SLICE`` bytes whose features are those of the whole, so memory beside the
text itself is bounded, however long its words are. Null texts score as empty ones, by the bias alone; rows with a null doc_id are
scored like others and count as not held out. Null labels are left out, repeated rows are scored each, an empty table gives an empty result and without labels every score is 0.5. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix64, remainder, spans
from .subwords import BASE, WordHasher, labelled_sample, ranges

SLICE = 1 << 20
#: Bytes kept of a word as its stem.
STEMS = (4, 5, 6)
#: Pairs of words: how far apart, and a number that tells the kinds apart.
GAPS = ((1, 0x51ED270B), (2, 0x2545F491))
_MASK = (1 << 64) - 1
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 255)]] = True


class Grams:
    """Slots of words, pairs and skip pairs of lower-case texts in UTF-8."""

    def __init__(self, bits: int) -> None:
        self.shift, self.words = np.uint64(64 - bits), WordHasher()

    def stems(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length of stems: the words that are longer, and their slots."""
        out = []
        for n in STEMS:
            longer = np.flatnonzero(stops - starts > n)
            out.append((longer, mix64(self.words(raw, starts[longer], starts[longer] + n) + np.uint64(n)) >> self.shift))
        return out

    def pairs(self, h: np.ndarray) -> list[np.ndarray]:
        """For each gap: slots of the words' pairs with it."""
        return [mix64(h[:-gap] * np.uint64(31) + np.uint64(salt) ^ h[gap:]) >> self.shift for gap, salt in GAPS]

    def __call__(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots and their texts' numbers, of joined texts. ``ends``: where texts end in ``raw`` (byte 255 stands there)."""
        starts, stops = ranges(_IN_WORD[raw])
        h = self.words(raw, starts, stops)
        doc = np.searchsorted(ends, starts)
        slots, docs = [h >> self.shift], [doc]
        for longer, got in self.stems(raw, starts, stops):
            slots.append(got)
            docs.append(doc[longer])
        for (gap, _), got in zip(GAPS, self.pairs(h), strict=True):
            same = doc[gap:] == doc[:-gap]
            slots.append(got[same])
            docs.append(doc[gap:][same])
        return np.concatenate(slots), np.concatenate(docs)

    def of_long(self, text: str) -> Iterator[np.ndarray]:
        """Slots of one text in slices of ``SLICE`` bytes at most, the same as those of the whole.

        A slice ends after its last byte outside words. The hashes of the last two words are carried on for pairs; a
        word that fills whole slices is hashed by parts, its hash's sum and its length being carried.
        """
        raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        last, total, length, at = np.zeros(0, np.uint64), 0, 0, 0
        while at < len(raw):
            part = raw[at : at + SLICE]
            gaps = np.flatnonzero(~_IN_WORD[part])
            if at + SLICE < len(raw) and len(gaps):
                part = part[: gaps[-1] + 1]
            at += len(part)
            starts, stops = ranges(_IN_WORD[part])
            sums = self.words.sums(part, starts, stops)
            fresh = starts
            if length:  # a word goes on, or has just ended
                if len(starts) and starts[0] == 0:
                    sums[0] = np.uint64((total + pow(BASE, length, 1 << 64) * int(sums[0])) & _MASK)
                    fresh = starts[1:]
                else:
                    sums = np.concatenate((np.array([total], np.uint64), sums))
            for _, got in self.stems(part, fresh, stops[len(stops) - len(fresh) :]):
                yield got
            if at < len(raw) and len(starts) and stops[-1] == len(part):  # the slice is all one word, which goes on
                total, length = int(sums[-1]), length + len(part)
                continue
            total = length = 0
            h = mix64(sums)
            yield h >> self.shift
            both = np.concatenate((last, h))
            for (gap, _), got in zip(GAPS, self.pairs(both), strict=True):
                yield got[max(0, len(last) - gap) :]  # those that end in this slice
            last = both[-2:]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(x) + 1 for x in raw]) - 1
    return np.frombuffer(b"\xff".join([*raw, b""]), np.uint8), ends


@dataclass(frozen=True)
class Model:
    bits: int
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        grams = Grams(self.bits)
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.slots] = self.weights

        def active(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Distinct (text, slot) among slots whose weight isn't zero."""
            slots, docs = grams(*joined(texts))
            on = np.flatnonzero(dense[slots])
            both = np.unique((docs[on].astype(np.uint64) << np.uint64(self.bits)) | slots[on])
            return (both >> np.uint64(self.bits)).astype(np.int64), both & np.uint64((1 << self.bits) - 1)

        def score(texts: list[str]) -> np.ndarray:
            out = np.zeros(len(texts))
            for a, b in spans([len(t) for t in texts], SLICE):
                if b - a == 1 and len(texts[a]) > SLICE:
                    seen = np.zeros(1 << self.bits, bool)
                    for slots in grams.of_long(texts[a]):
                        seen[slots] = True
                    out[a] = dense[seen].sum(dtype=np.float64)
                else:
                    docs, slots = active(texts[a:b])
                    out[a:b] = np.bincount(docs, dense[slots], b - a)
            return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))

        return score


def train(rows: list[tuple[int, np.ndarray]], bits: int, epochs: int = 8, alpha: float = 0.3, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, seed: int = 11, level: float = 1.0) -> Model:
    """``rows``: label and distinct slots. ``level``: 0 weighs all rows alike, 1 gives both classes the same weight."""
    labels = np.array([y for y, _ in rows], int)
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    if len(rows) == 0:
        return Model(bits, *none, 0.0)
    if labels.min() == labels.max():
        return Model(bits, *none, 3.0 if labels[0] else -3.0)
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        lasso = np.where(at == 1 << bits, 0.0, l1)
        return np.where(np.abs(zs) <= lasso, 0.0, -(zs - np.sign(zs) * lasso) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    weigh = (len(rows) / 2 / np.bincount(labels, minlength=2)) ** level
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i][1].astype(np.int64), 1 << bits)  # the last is the bias
            w = weights(at)
            g = weigh[labels[i]] * (1 / (1 + math.exp(-max(-30.0, min(30.0, w.sum())))) - labels[i])
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange((1 << bits) + 1))
    slots = np.flatnonzero(w[:-1]).astype(np.uint64)
    return Model(bits, slots, w[:-1][slots.astype(np.int64)].astype(np.float32), float(w[-1]))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 3, held_out: int = 1, sample: int = 3000, chars: int = 1 << 25, bits: int = 20) -> Model:
    """A model of ``labels``.``label``, from rows whose crc32(doc_id as text) mod ``fold`` is not ``held_out``."""
    rows, _ = labelled_sample(labels, documents, label, fold, held_out, sample, chars)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(bits)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                seen = np.zeros(1 << bits, bool)
                for slots in grams.of_long(text):
                    seen[slots] = True
                out.append(np.flatnonzero(seen).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(out, pa.binary())], ["y", "slots"])

    got = rows.mapInArrow(frugal(hashed), "y int, slots binary").toArrow()
    data = sorted(zip(got.column("y").to_pylist(), got.column("slots").to_pylist(), strict=True))
    return train([(y, np.frombuffer(s, np.uint32)) for y, s in data], bits)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document, from its text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(batch.column("text").to_pylist()))], ["doc_id", "score"])

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(frugal(run), rows.select("doc_id").schema.add("score", "double"))


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(documents, fit(documents, labels, **options))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
