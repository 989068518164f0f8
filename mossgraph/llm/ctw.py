"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Every decision is predicted in all contexts of 0 to ``DEPTH`` preceding bytes, by
Krichevsky-Trofimov estimates from the training documents' counts; the estimates are mixed along the path with the weights
of the context tree, which follow from the counts alone. A path ends at the deepest context that occurs in training.
What is modelled is the sequence of lower-cased words (only A-Z change), joined by single spaces, and then an end mark (byte 255),
each document by itself.

Scale: nothing of the model is broadcast but two tables over the nearest byte, of 256 * 256 numbers each. Tasks pack their texts into
chunks of about ``CHUNK`` bytes and send, to buckets chosen by the two nearest context bytes, the chunk's distinct
(DEPTH + 1)-grams with their training counts; a bucket sums them, builds its part of the tree and answers each chunk with the
log probabilities of just the grams it sent. Words and their counts go the same way. Messages are thus distinct grams, not
positions, and grow with the input; a hot gram or word is one entry for each chunk. The number of buckets grows with the input's partitions.

Null and empty texts are the end mark alone. A null doc_id is scored like others (its fold is that of a null remainder: training). Repeated rows count and
return each. Very long texts are a chunk of their own. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix64, remainder, stored

DEPTH = 5
CHUNK = 12 << 20
STEP = 1 << 16
END = 255
_ROWS = "kind string, chunk long, bucket int, a binary, b binary, c binary"
_LOG_HALF = math.log(0.5)


def pack(x: np.ndarray | bytes) -> bytes:
    return pa.compress(x if isinstance(x, bytes) else x.tobytes(), "zstd", asbytes=True) + len(x if isinstance(x, bytes) else x.tobytes()).to_bytes(8, "little")


def unpack(x: bytes, kind=None):
    raw = pa.decompress(x[:-8], int.from_bytes(x[-8:], "little"), "zstd", asbytes=True) if len(x) > 8 and x[-8:] != bytes(8) else b""
    return raw if kind is None else np.frombuffer(raw, kind)


def normal(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with DEPTH end bytes before, between and after them; where each begins, and where it ends (its end mark)."""
    pad = bytes([END]) * DEPTH
    lens = np.array([len(t) for t in texts], np.int64)
    begins = DEPTH + np.cumsum(lens + DEPTH) - lens - DEPTH
    return np.frombuffer(pad + pad.join([*texts, b""]), np.uint8), begins, begins + lens


def grams(raw: np.ndarray, start: int, stop: int) -> np.ndarray:
    """For the positions from start to stop: nearest byte first, then the ones before, the byte itself last."""
    out = raw[start - 1 : stop - 1].astype(np.uint64)
    for back in range(2, DEPTH + 1):
        out <<= np.uint64(8)
        out |= raw[start - back : stop - back]
    out <<= np.uint64(8)
    out |= raw[start:stop]
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts' sums."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def chunk_grams(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a chunk's texts and their counts in training texts."""
    keys, counts = [], []
    for flag in (True, False):
        raw, _, ends = stream([t for t, on in zip(texts, train, strict=True) if on == flag])
        pads = (ends[:, None] + np.arange(1, DEPTH)).ravel()
        for at in range(DEPTH, len(raw), 1 << 20):
            stop = min(at + (1 << 20), len(raw))
            got = grams(raw, at, stop)
            mask = np.ones(stop - at, bool)
            mask[pads[(pads >= at) & (pads < stop)] - at] = False
            got = np.sort(got[mask])
            if len(got):
                first = np.flatnonzero(np.concatenate(([True], got[1:] != got[:-1])))
                keys.append(got[first])
                counts.append((np.diff(np.append(first, len(got))) * flag).astype(np.int64))
    return summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _places(buckets: int) -> np.ndarray:
    return (mix64(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of ascending keys by bucket, and where buckets begin in it."""
    place = _places(buckets)[(keys >> np.uint64(8 * DEPTH - 8)).astype(np.int64)]
    order = np.argsort(place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(buckets + 1))


def word_lists(texts: list[bytes], train: np.ndarray, buckets: int) -> list[dict[bytes, int]]:
    """For each bucket: the chunk's words and their counts in training texts."""
    seen: dict[bytes, int] = {}
    for text, on in zip(texts, train.tolist(), strict=True):
        for w in text.split():
            seen[w] = seen.get(w, 0) + on
    out: list[dict[bytes, int]] = [{} for _ in range(buckets)]
    for w, c in seen.items():
        out[xxhash.xxh3_64_intdigest(w) % buckets][w] = c
    return out


def chunks(documents: DataFrame, held_out, buckets: int) -> DataFrame:
    """Rows of kind docs (a: text, b: lengths and flags, c: ids), grams (a: keys, b: counts) and words (a: words, b: counts)."""

    def messages(number: int, ids: list[int], texts: list[bytes], train: list[bool]) -> Iterator[tuple]:
        on = np.array(train, bool)
        yield "docs", number, -1, pack(b"".join(texts)), pack(np.array([[len(t), f] for t, f in zip(texts, train, strict=True)], np.int64)), pack(np.array(ids, np.int64))
        keys, counts = chunk_grams(texts, on)
        order, cuts = dealt(keys, buckets)
        for k in range(buckets):
            part = order[cuts[k] : cuts[k + 1]]
            if len(part):
                yield "grams", number, k, pack(np.diff(keys[part], prepend=np.uint64(0))), pack(counts[part].astype(np.uint32)), None
        for k, words in enumerate(word_lists(texts, on, buckets)):
            if words:
                yield "words", number, k, pack(b" ".join(words)), pack(np.fromiter(words.values(), np.uint32, len(words))), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, texts, train, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row in messages(number, ids, texts, train):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["kind", "chunk", "bucket", "a", "b", "c"])

        for batch in batches:
            for i, on in enumerate(batch.column("train").to_pylist()):
                text = normal(batch.column("text")[i].as_py())
                if texts and size + len(text) > CHUNK:
                    yield from flush()
                    number += 1
                    ids, texts, train, size = [], [], [], 0
                ids.append(batch.column("id")[i].as_py())
                texts.append(text)
                train.append(on)
                size += len(text)
        if texts:
            yield from flush()

    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce("text", F.lit("")).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    return rows.mapInArrow(frugal(run), _ROWS)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x of 0.5 or more, by Stirling's series after a shift of 8."""
    y = x + 8.0
    r = 1 / y
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + r * (1 / 12 - r * r * (1 / 360 - r * r / 1260))
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a block with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


class Nodes:
    """Binary nodes of one depth and one bit: sorted names (context, then the bits so far), counts and weighted probabilities."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int) -> None:
        """``keys``: ascending context * 256 + byte."""
        name = keys >> np.uint64(8 - bit)
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1]))) if len(name) else np.zeros(0, int)
        self.names = name[first]
        ones = np.where((keys >> np.uint64(7 - bit)) & np.uint64(1), counts, 0)
        self.ones = np.add.reduceat(ones, first).astype(np.float64) if len(first) else np.zeros(0)
        self.all = np.add.reduceat(counts, first).astype(np.float64) if len(first) else np.zeros(0)
        self.own = kt(self.all - self.ones, self.ones)
        self.mixed = self.own
        self.share = np.ones(len(first))

    def weigh(self, below: np.ndarray) -> None:
        """``below``: sums of the children's weighted log probabilities."""
        self.mixed = np.logaddexp(_LOG_HALF + self.own, _LOG_HALF + below)
        self.share = np.exp(_LOG_HALF + self.own - self.mixed)

    def gather(self, deeper: Nodes, bit: int) -> np.ndarray:
        parent = ((deeper.names >> np.uint64(bit + 8)) << np.uint64(bit)) | (deeper.names & np.uint64((1 << bit) - 1))
        return np.bincount(np.searchsorted(self.names, parent), deeper.mixed, len(self.names))


def grown(keys: np.ndarray, counts: np.ndarray) -> list[list[Nodes]]:
    """[depth - 2][bit] for depths 2 to DEPTH, weighted, from the training grams of whole depth-2 contexts."""
    levels = []
    for depth in range(DEPTH, 1, -1):
        levels.append((keys, counts))
        context, byte = keys >> np.uint64(16), keys & np.uint64(255)
        keys, counts = summed((context << np.uint64(8)) | byte, counts)
    tree = [[Nodes(k, c, bit) for bit in range(8)] for k, c in reversed(levels)]
    for depth in range(len(tree) - 2, -1, -1):
        for bit in range(8):
            tree[depth][bit].weigh(tree[depth][bit].gather(tree[depth + 1][bit], bit))
    return tree


def upper(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a bucket adds to depth 1: names (nearest byte * 256 + heap number of the bits so far), and columns zeros, ones and sum of the weighted depth-2 children."""
    names, values = [], []
    for bit, nodes in enumerate(grown(keys, counts)[0]):
        heap = (nodes.names & np.uint64((1 << bit) - 1)) | np.uint64(1 << bit)
        at = ((nodes.names >> np.uint64(bit + 8)) << np.uint64(8)) | heap
        own, back = np.unique(at, return_inverse=True)
        names.append(own)
        values.append(np.column_stack([np.bincount(back, v, len(own)) for v in (nodes.all - nodes.ones, nodes.ones, nodes.mixed)]))
    return np.concatenate(names), np.concatenate(values)


class Top:
    """Depths 0 and 1 as whole tables: the estimate of a one, the share that it has in the mixture, and whether it occurs."""

    def __init__(self, names: np.ndarray, values: np.ndarray) -> None:
        flat = np.zeros((1 << 16, 3))
        np.add.at(flat, names.astype(np.int64), values)
        zeros, ones, below = flat.reshape(256, 256, 3).transpose(2, 0, 1)
        self.seen1 = zeros + ones > 0
        own = kt(zeros, ones)
        mixed = np.where(self.seen1, np.logaddexp(_LOG_HALF + own, _LOG_HALF + below), 0.0)
        self.share1, self.one1 = np.exp(_LOG_HALF + own - mixed), (ones + 0.5) / (zeros + ones + 1)
        zeros, ones, below = zeros.sum(0), ones.sum(0), mixed.sum(0)
        own = kt(zeros, ones)
        self.seen0 = zeros + ones > 0
        self.share0, self.one0 = np.exp(_LOG_HALF + own - np.logaddexp(_LOG_HALF + own, _LOG_HALF + below)), (ones + 0.5) / (zeros + ones + 1)


def answers(asked: np.ndarray, keys: np.ndarray, counts: np.ndarray, top: Top) -> np.ndarray:
    """log10 probability of each gram's last byte after its others."""
    tree = grown(keys, counts)
    near, byte = (asked >> np.uint64(8 * DEPTH)).astype(np.int64), asked & np.uint64(255)
    out = np.zeros(len(asked))
    for bit in range(8):
        so_far = byte >> np.uint64(8 - bit)
        p, deeper = np.full(len(asked), 0.5), np.zeros(len(asked), bool)
        for depth in range(DEPTH, 1, -1):
            nodes = tree[depth - 2][bit]
            if not len(nodes.names):
                continue
            name = ((asked >> np.uint64(8 * (DEPTH - depth) + 8)) << np.uint64(bit)) | so_far
            at = np.minimum(np.searchsorted(nodes.names, name), len(nodes.names) - 1)
            seen = nodes.names[at] == name
            one = (nodes.ones[at] + 0.5) / (nodes.all[at] + 1)
            share = np.where(deeper, nodes.share[at], 1.0)
            p = np.where(seen, share * one + (1 - share) * p, p)
            deeper |= seen
        heap = (so_far | np.uint64(1 << bit)).astype(np.int64)
        for seen, share, one in ((top.seen1[near, heap], top.share1[near, heap], top.one1[near, heap]), (top.seen0[heap], top.share0[heap], top.one0[heap])):
            share = np.where(deeper, share, 1.0)
            p = np.where(seen, share * one + (1 - share) * p, p)
            deeper |= seen
        on = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        out += np.log10(np.where(on, p, 1 - p))
    return out


def _merged(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    sent = [np.cumsum(unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in rows.column("a")]
    keys, counts = summed(np.concatenate(sent), np.concatenate([unpack(x.as_py(), np.uint32) for x in rows.column("b")]).astype(np.int64))
    return sent, keys[counts > 0], counts[counts > 0]


def tops(rows: pa.Table) -> pa.Table:
    """name, zeros, ones, below: a bucket's part of depth 1; and of its words, under name -1, tokens and distinct ones."""
    names, values = np.zeros(0, np.int64), np.zeros((0, 3))
    kinds = np.array(rows.column("kind").to_pylist())
    if (kinds == "grams").any():
        _, keys, counts = _merged(rows.filter(pa.array(kinds == "grams")))
        if len(keys):
            names, values = upper(keys, counts)
    if (kinds == "words").any():
        found = word_counts(rows.filter(pa.array(kinds == "words")))
        names, values = np.append(names.astype(np.int64), -1), np.vstack([values, [sum(found.values()), sum(c > 0 for c in found.values()), 0]])
    return pa.table([pa.array(names.astype(np.int64)), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(3))], ["name", "zeros", "ones", "below"])


def word_counts(rows: pa.Table) -> dict[bytes, int]:
    found: dict[bytes, int] = {}
    for a, b in zip(rows.column("a"), rows.column("b"), strict=True):
        for w, c in zip(unpack(a.as_py()).split(b" "), unpack(b.as_py(), np.uint32).tolist(), strict=True):
            found[w] = found.get(w, 0) + c
    return found


def replies(rows: pa.Table, top: Top) -> pa.Table:
    """A bucket's answers: rows of kind grams or words with c in place of counts."""
    kinds = np.array(rows.column("kind").to_pylist())
    out: list[tuple] = []
    grams_, words = rows.filter(pa.array(kinds == "grams")), rows.filter(pa.array(kinds == "words"))
    if grams_.num_rows:
        sent, keys, counts = _merged(grams_)
        asked = np.unique(np.concatenate(sent))
        score = np.concatenate([answers(asked[at : at + (1 << 18)], keys, counts, top) for at in range(0, len(asked), 1 << 18)]).astype(np.float32)
        for s, a, chunk, bucket in zip(sent, grams_.column("a"), grams_.column("chunk").to_pylist(), grams_.column("bucket").to_pylist(), strict=True):
            out.append(("grams", chunk, bucket, a.as_py(), None, pack(score[np.searchsorted(asked, s)])))
    if words.num_rows:
        found = word_counts(words)
        for a, chunk, bucket in zip(words.column("a"), words.column("chunk").to_pylist(), words.column("bucket").to_pylist(), strict=True):
            own = unpack(a.as_py()).split(b" ")
            out.append(("words", chunk, bucket, a.as_py(), None, pack(np.fromiter(map(found.__getitem__, own), np.int64, len(own)))))
    cols = list(zip(*out, strict=True))
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["kind", "chunk", "bucket", "a", "b", "c"])


def chunk_scores(rows: pa.Table, documents: int, tokens: int, distinct: int) -> pa.Table:
    """Scores of one chunk's documents, from its texts and the answers to it."""
    kinds = rows.column("kind").to_pylist()
    keys, values, logs = [], [], {}
    known = set()
    for kind, a, b, c in zip(kinds, rows.column("a"), rows.column("b"), rows.column("c"), strict=True):
        if kind == "docs":
            whole, ids = unpack(a.as_py()), unpack(c.as_py(), np.int64)
            sizes = unpack(b.as_py(), np.int64).reshape(-1, 2)
        elif kind == "grams":
            keys.append(np.cumsum(unpack(a.as_py(), np.uint64), dtype=np.uint64))
            values.append(unpack(c.as_py(), np.float32))
        else:
            for w, n in zip(unpack(a.as_py()).split(b" "), unpack(c.as_py(), np.int64).tolist(), strict=True):
                logs[w] = math.log10(n + 0.5)
                if n:
                    known.add(w)
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    cuts = np.concatenate(([0], np.cumsum(sizes[:, 0])))
    texts = [whole[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    raw, begins, ends = stream(texts)
    each = np.zeros(len(raw), np.float32)
    bits = np.uint64(16)
    for at in range(DEPTH, len(raw), STEP):  # short blocks: grams and places sort together in one 64-bit number
        stop = min(at + STEP, len(raw))
        both = (grams(raw, at, stop) << bits) | np.arange(stop - at, dtype=np.uint64)
        both.sort()
        g = both >> bits
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        found = values[np.minimum(np.searchsorted(keys, g[first]), len(keys) - 1)]  # padding finds anything; it isn't summed
        each[at + (both & np.uint64(STEP - 1)).astype(np.int64)] = np.repeat(found, np.diff(np.append(first, len(g))))
    sums = np.add.reduceat(each, np.column_stack([begins, ends + 1]).ravel(), dtype=np.float64)[::2]
    per, end = math.log10(tokens + 0.5 * (distinct + 1)), math.log10(documents + 0.5)
    n_tokens, n_known, base = [], [], []
    for text in texts:
        words = text.split()
        n_tokens.append(len(words) + 1)
        n_known.append(sum(map(known.__contains__, words)) + (documents > 0))
        base.append(math.fsum(map(logs.__getitem__, words)) + end - per * (len(words) + 1))
    return pa.table([pa.array(ids), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(sums), pa.array(sizes[:, 0] + 1)], ["id", "n_tokens", "n_known", "base_score", "score", "n_bytes"])


def scores(documents: DataFrame, fold: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row; training rows are those whose crc32(doc_id as text) mod ``fold`` isn't ``held_out``."""
    out_of = remainder("doc_id", fold) == held_out
    buckets = max(4, min(4096, documents.select("doc_id").rdd.getNumPartitions()))
    sent = stored(chunks(documents, out_of, buckets))
    asked = sent.where("kind <> 'docs'")
    part = asked.groupBy("bucket").applyInArrow(tops, "name long, zeros double, ones double, below double")
    total = np.array([tuple(r) for r in part.groupBy("name").agg(*(F.sum(c) for c in ("zeros", "ones", "below"))).collect()], np.float64).reshape(-1, 4)  # 256 * 256 rows at most
    words = total[total[:, 0] < 0]
    top = Top(total[total[:, 0] >= 0][:, 0], total[total[:, 0] >= 0][:, 1:])
    training = documents.where(~F.coalesce(out_of, F.lit(False))).count()
    tokens = int(words[:, 1].sum()) + training
    distinct = int(words[:, 2].sum()) + (training > 0)
    shared = documents.sparkSession.sparkContext.broadcast(top)
    back = asked.groupBy("bucket").applyInArrow(lambda t: replies(t, shared.value), _ROWS)
    got = sent.where("kind = 'docs'").unionAll(back).groupBy("chunk").applyInArrow(lambda t: chunk_scores(t, training, tokens, distinct), "id long, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    doc = F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id")
    return got.select(doc, "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte")).withColumn("held_out", F.coalesce(remainder("doc_id", fold) == held_out, F.lit(False)))
