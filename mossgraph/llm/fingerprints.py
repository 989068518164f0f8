"""Document fingerprints: canonical exact digests.

A text's canonical form is its NFKC normal form, case-folded, normalised again, with every run of white space as one
space and none at the ends. Its digest is the 128-bit xxhash of that form. Documents with equal digests form a bucket;
inside buckets of several rows the canonical bytes are compared (the bucket's least and greatest must be equal), and the
documents of a bucket that fails get their SHA-256 appended, so equal fingerprints mean equal canonical texts.

Likeness to the edited and to the next text is 1 where the canonical bytes are equal, else 0: an exact digest has no degrees.

Scale: documents are dealt out once, by ranges of doc_id (of doc_id and a hash of the text where one id has many rows), and sorted
within them, so that each finds the next one beside it; the first row of a range is copied to the range before. Only texts
whose digest may be in a bucket of several rows are dealt out again: a bit map of ``2 ** BITS`` bits tells them. A hot bucket is no
burden there, as every task first reduces its own part of it to two texts. Only repeated rows, of one id and one text, stay in one range.

Nulls: a null text counts as an empty one; rows with a null doc_id come first. Rows with an equal doc_id follow each other in the order of a
hash of their texts. Very long texts are handled whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, stored

ROWS = 4096
BITS = 23
_ROWS = "doc_id long, n_chars long, edited_sha256 string, digest string, edited_digest string, like_edited boolean, like_next boolean"


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def alike(a: str, b: str) -> bool:
    """Whether canonical texts are equal, byte by byte."""
    return a == b or canonical(a) == canonical(b)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


def neighbours(documents: DataFrame) -> DataFrame:
    """For every row, in ascending doc_id: doc_id, n_chars, edited_sha256, digest, edited_digest, and whether its canonical text is that of the edited one and of the next one; after the last comes the first."""
    docs = documents.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = documents.sparkSession
    h = F.xxhash64("text").alias("h")
    ids = docs.select("id")
    parts = max(1, min(4096, ids.rdd.getNumPartitions() * 2))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    quantiles = ids.agg(F.percentile_approx("id", shares, 10_000)).first()[0] or []
    marks = [(q, None) for q in sorted(set(quantiles))]
    for hot in sorted({q for q in quantiles if quantiles.count(q) > 1}):  # an id that fills several ranges: they are cut by its texts' hashes too
        own = docs.where(F.col("id") == hot).select(h).agg(F.percentile_approx("h", shares[:: max(1, parts // (quantiles.count(hot) + 1))], 10_000)).first()[0] or []
        marks += [(hot, x) for x in sorted(set(own))]
    marks.sort(key=lambda m: (m[0], -(1 << 63) if m[1] is None else m[1]))
    dealt = docs.select("*", h).withColumn("part", _rank(marks))
    firsts = sorted((r["part"], r["first"]["id"], r["first"]["h"]) for r in dealt.groupBy("part").agg(F.min(F.struct("id", "h")).alias("first")).collect())  # a row for each range
    if not firsts:
        return spark.createDataFrame([], _ROWS)
    last = firsts[-1][0]
    ahead = [(i, hh, firsts[k - 1][0]) for k, (_, i, hh) in enumerate(firsts)]  # the range before; that of the least row: the last
    before = F.broadcast(spark.createDataFrame(ahead, "id long, h long, to int"))
    rows = dealt.select("part", F.lit(0).alias("copy"), "id", "doc_id", "h", "text")
    copies = dealt.drop("part").join(before, ["id", "h"]).select(F.col("to").alias("part"), F.lit(1).alias("copy"), "id", "doc_id", "h", "text")
    copies = copies.groupBy("part", "copy", "id", "h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))  # repeated rows: one is enough
    wraps = (F.col("copy") == 1) & (F.col("part") == last)  # the least row follows the greatest
    both = rows.unionByName(copies).withColumn("id", F.when(wraps, F.lit((1 << 63) - 1)).otherwise(F.col("id"))).repartition(len(firsts), "part").sortWithinPartitions("part", "copy", "id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, doc_id, text
        got: list[tuple] = []

        def names() -> pa.RecordBatch:
            cols = list(zip(*got, strict=True)) if got else [[] for _ in range(7)]
            got.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.bool_(), pa.bool_()], strict=True)], ["doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "like_edited", "like_next"])

        own = None
        for batch in batches:
            part, copy, doc_id = (batch.column(c).to_pylist() for c in ("part", "copy", "doc_id"))
            for i in range(len(part)):
                text = batch.column("text")[i].as_py()
                fresh = None
                if held is not None and held[0] == part[i]:
                    fresh = digest(text)
                    changed = edited(held[2], text)
                    after = own if changed == held[2] else digest(changed)
                    got.append((held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, after, after == own and alike(held[2], changed), fresh == own and alike(held[2], text)))
                if copy[i]:
                    held = None  # one copy, of the range's next row, is enough
                else:
                    held, own = (part[i], doc_id[i], text), fresh or digest(text)
                if len(got) >= ROWS:
                    yield names()
        yield names()

    return both.mapInArrow(frugal(run), _ROWS)


def _rank(marks: list[tuple[int, int | None]]) -> Column:
    """How many marks, of an id and maybe a hash, are at most the row's: a range's number, by binary choice."""

    def choose(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        i, h = marks[m]
        under = F.col("id") < i if h is None else (F.col("id") < i) | ((F.col("id") == i) & (F.col("h") < h))
        return F.when(under, choose(a, m)).otherwise(choose(m + 1, b))

    return choose(0, len(marks))


def canonical_texts(documents: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """doc_id, digest, canonical bytes; only of rows whose digest's slot is set in the bit map ``among``, if given."""
    shared = documents.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = shared.value
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                form = canonical(text)
                name = xxhash.xxh3_128_hexdigest(form)
                if chosen is None or chosen[int(name[:6], 16) >> (24 - BITS)]:
                    out.append((ids[i], name, form))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary()), strict=True)], ["doc_id", "digest", "form"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, digest string, form binary")


def compared(documents: DataFrame, names: DataFrame) -> DataFrame:
    """digest, doc_id, sha of the documents in buckets that hold different canonical bytes. ``names`` has every row's digest."""
    slot = F.shiftright(F.conv(F.substr("digest", F.lit(1), F.lit(6)), 16, 10).cast("long"), 24 - BITS)
    several = names.groupBy("digest").count().where("count > 1").select((slot + 1).alias("slot"))  # bits count from 1
    maps = several.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()  # 2 ** BITS bits at most
    among = np.zeros(1 << BITS, bool)
    for k, bits in maps:
        got = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        among[(k - 1) * len(got) : k * len(got)] |= got.astype(bool)
    forms = canonical_texts(documents, among)
    mixed = stored(forms.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("most")).where("least <> most").select("digest"))
    if mixed.isEmpty():  # but for colliding digests there is none, and no bucket's rows need to meet
        return documents.sparkSession.createDataFrame([], "digest string, doc_id long, sha string")
    return forms.join(mixed, "digest").select("digest", "doc_id", F.sha2("form", 256).alias("sha")).distinct()


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = stored(neighbours(documents))
    other = compared(documents, rows).withColumnRenamed("doc_id", "other_id").withColumnRenamed("digest", "other")
    named = rows.join(other, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("digest") == F.col("other")), "left")
    near = lambda c: F.col(c).cast("double")
    return named.select("doc_id", "n_chars", "edited_sha256", F.concat_ws("-", "digest", "sha").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), near("like_edited").alias("near_edited"), near("like_next").alias("near_next"))
