"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set holds its distinct shingles of ``WORDS`` words (a shorter document: its whole sequence). Its signature has
``H`` coordinates, each the least value of the set under one scrambling. Equal sets are one class with a number of
its own, so copies are never paired; components are of classes. Classes are posted under (coordinate, value) pairs. Two sets of similarity
0.75 agree in fewer than ``LEAST`` of 32 coordinates with a probability of about 3 in a million; a pair that agrees in
``LEAST`` shares, by the prefix principle, one of the ``m - LEAST + 1`` rarest of its m shared pairs, so only those are
posted: pairs that many documents have through a common passage stay out unless nothing rarer is there. Lists of the
same members are read once. Lists are worked off in cells of at most ``2 * BLOCK`` members, in which collisions are counted,
pairs that an earlier list of theirs covers are skipped, those with ``LEAST`` collisions are checked on their full
sets, and only a spanning forest of the true links leaves the cell. Links then merge to components.

Scale: no group of copies, hot pair or list is ever gathered in one task; lists larger than a block are split into cells,
and of a cell's links fewer leave than it has members. Sets are built again from the text only for the posted classes,
which a bit map of ``2 ** BITS`` bits tells. Lineage is cut by tables in the shared folder.

Null and empty texts, or such without words, have no shingles, link with nothing and are kept. Rows with one doc_id
(repeated rows) are one node, which links with the near copies of each of their texts. Every row with a null doc_id is a node
of its own: it links by its text alone, takes its group's smallest doc_id and isn't kept beside it; of a group without any doc_id the component_id is null and
one row is kept. Very long texts are read whole. An empty table
gives an empty result. Other columns are ignored, or carried along by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix64, replaced, spare, stored

WORDS, NEAR = 5, 75
H, LEAST = 32, 12
BLOCK = 512
BITS = 23
_SALTS = mix64(np.arange(1, H + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACES = mix64(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h += w[j : j + len(h)] * _PLACES[j]
    return np.unique(mix64(h))


def signature(s: np.ndarray) -> np.ndarray:
    """For each coordinate, the upper half of the least scrambled shingle."""
    least = np.full(H, ~np.uint64(0))
    for at in range(0, len(s), 1 << 14):
        part = (s[None, at : at + (1 << 14)] ^ _SALTS[:, None]) * np.uint64(0x9FB21C651E98DF25)
        np.minimum(least, part.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(documents: DataFrame) -> DataFrame:
    """id (doc_id), mark (of rows without an id: a digest of the text), n_shingles, cls (digest of the set) and sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, sigs = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py())
                sizes.append(len(s))
                names.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())], ["id", "mark", "n_shingles", "cls", "sig"])

    return _texts(documents).mapInArrow(frugal(run), "id long, mark string, n_shingles long, cls binary, sig binary")


def _texts(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("doc_id").isNull(), F.sha2(text, 256)).alias("mark"), text.alias("text"))


def posted(classes: DataFrame) -> DataFrame:
    """id and key of every class (id, sig) under its rarest shared coordinate-value pairs; key is coordinate * 2 ** 32 + value."""
    values = [F.conv(F.hex(F.substring("sig", 4 * i + 1, 4)), 16, 10).cast("long") for i in range(H)]
    keys = classes.select("id", F.explode(F.array(*[v + F.lit(i << 32) for i, v in enumerate(values)])).alias("key"))
    common = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = keys.join(common, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))  # H entries at most
    prefix = F.slice("keys", 1, F.size("keys") - LEAST + 1)
    return shared.where(F.size("keys") >= LEAST).select("id", F.explode(prefix).alias("k")).select("id", "k.key")


def lists(rows: DataFrame) -> DataFrame:
    """id, key, n, mask of the lists to work off: of lists with the same members only the one of the least key. Bits of mask: the id's coordinates that are worked off."""
    kept = (
        rows.groupBy("key")
        .agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("id"), 20)).alias("s"), F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 20)).alias("t"), F.min("id").alias("low"), F.max("id").alias("high"))
        .where("n > 1")
        .groupBy("n", "s", "t", "low", "high")
        .agg(F.min("key").alias("key"))
        .select("key", "n")
    )
    chosen = stored(rows.join(stored(kept), "key"))
    masks = chosen.groupBy("id").agg(F.expr("bit_or(shiftleft(1L, cast(shiftright(key, 32) AS int))) AS mask"))
    return chosen.join(masks, "id")


def bitmap(slots: DataFrame) -> np.ndarray:
    """A bit for each of 2 ** BITS slots; its size doesn't depend on the data."""
    slot = F.col("slot") + 1  # these functions count bits from 1
    rows = slots.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(1 << BITS, bool)
    for k, bits in rows:
        got = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        out[(k - 1) * len(got) : k * len(got)] |= got.astype(bool)
    return out


def sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """id (the class's number), sig, items of the classes ``wanted`` (number, cls, and id and mark of one of its rows)."""
    slot = F.pmod(F.xxhash64("id", "mark"), F.lit(1 << BITS)).alias("slot")
    among = documents.sparkSession.sparkContext.broadcast(bitmap(wanted.select(slot)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = among.value
        for batch in batches:
            got = [shingles(batch.column("text")[int(i)].as_py()) for i in np.flatnonzero(chosen[batch.column("slot").to_numpy()])]
            got = [s for s in got if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([f(s) for s in got], pa.binary()) for f in (lambda s: xxhash.xxh3_128_digest(s.tobytes()), lambda s: signature(s).tobytes(), lambda s: s.tobytes())], ["cls", "sig", "items"])

    made = _texts(documents).select(slot, "text").mapInArrow(frugal(run), "cls binary, sig binary, items binary")
    one = made.groupBy("cls").agg(F.first("sig").alias("sig"), F.first("items").alias("items"))  # copies meet in each task first
    return one.join(wanted.select("cls", "number").hint("merge"), "cls").select(F.col("number").alias("id"), "sig", "items")


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def common_counts(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all ``rows`` with all ``cols``, by products of incidence matrices over slices of the items that both sides have."""
    r, c = np.concatenate(rows), np.concatenate(cols)
    both = np.intersect1d(r, c)
    rd, cd = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.repeat(np.arange(len(cols)), [len(x) for x in cols])
    ri, ci = np.searchsorted(both, r), np.searchsorted(both, c)
    rk, ck = both[np.minimum(ri, len(both) - 1)] == r if len(both) else np.zeros(len(r), bool), both[np.minimum(ci, len(both) - 1)] == c if len(both) else np.zeros(len(c), bool)
    out = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, len(both), 2048):
        x, y = np.zeros((len(rows), 2048), np.float32), np.zeros((len(cols), 2048), np.float32)
        on = rk & (ri >= at) & (ri < at + 2048)
        x[rd[on], ri[on] - at] = 1
        on = ck & (ci >= at) & (ci < at + 2048)
        y[cd[on], ci[on] - at] = 1
        out += x @ y.T
    return out


def cell_links(ids: np.ndarray, sig: np.ndarray, masks: np.ndarray, items: list[np.ndarray], blocks: np.ndarray, i: int, j: int, coordinate: int) -> list[tuple[int, int]]:
    """A spanning forest of the true links between members of block i and of block j."""
    a, b = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    if not len(a) or not len(b):
        return []
    hits = np.zeros((len(a), len(b)), np.uint8)
    earlier = np.zeros((len(a), len(b)), bool)
    for c in range(H):
        same = sig[a, c][:, None] == sig[b, c][None, :]
        hits += same
        if c < coordinate:
            on = np.uint64(1 << c)
            earlier |= same & ((masks[a] & on) > 0)[:, None] & ((masks[b] & on) > 0)[None, :]
    open_ = (hits >= LEAST) & ~earlier
    if i == j:
        open_ &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    x, y = np.nonzero(open_)
    if not len(x):
        return []
    sizes = np.array([len(s) for s in items])
    if len(x) > 64 and len(x) * 8 > len(a) + len(b):
        ax, ix = np.unique(x, return_inverse=True)
        by, iy = np.unique(y, return_inverse=True)
        inter = common_counts([items[a[k]] for k in ax], [items[b[k]] for k in by])[ix, iy].astype(np.int64)
    else:
        inter = np.array([len(np.intersect1d(items[a[p]], items[b[q]], assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
    linked = 100 * inter >= NEAR * (sizes[a[x]] + sizes[b[y]] - inter)
    forest = _Forest(len(ids))
    return [(int(ids[a[p]]), int(ids[b[q]])) for p, q in zip(x[linked], y[linked], strict=True) if forest.join(int(a[p]), int(b[q]))]


def links(members: DataFrame, contents: DataFrame) -> DataFrame:
    """a, b: links between classes, enough of them for the same components. ``members``: id, key, n, mask; ``contents``: id, sig, items."""
    width = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(5)), width.cast("long")).cast("int")
    rows = members.join(contents, "id").select("key", "id", "mask", "sig", "items", block.alias("block"), width.alias("width"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("other"))
    cells = rows.select("key", "id", "mask", "sig", "items", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = cells.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def over() -> list[tuple[int, int]]:
            if cell is None or len(held) < 2:
                return []
            ids = np.array([r[0] for r in held])
            sig = np.array([np.frombuffer(r[2], np.uint32) for r in held])
            return cell_links(ids, sig, np.array([r[1] for r in held], np.uint64), [np.frombuffer(r[3], np.uint64) for r in held], np.array([r[4] for r in held]), cell[1], cell[2], cell[0] >> 32)

        for batch in batches:
            cols = [batch.column(c) for c in ("key", "i", "j", "id", "mask", "sig", "items", "block")]
            keys, i, j, ids, masks = (c.to_pylist() for c in cols[:5])
            blocks = cols[7].to_pylist()
            found = []
            for r in range(len(keys)):
                if (keys[r], i[r], j[r]) != cell:
                    found += over()
                    cell, held = (keys[r], i[r], j[r]), []
                held.append((ids[r], masks[r], cols[5][r].as_py(), cols[6][r].as_py(), blocks[r]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])
        found = over()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(frugal(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each node of ``edges`` (a, b) is connected with. Labels spread to neighbours and then jump to their label's label, until none changes."""
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    before = None
    while True:
        now = state.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return state
        before = now
        near = both.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        spread = state.join(near, "node").select("node", F.least("component", "m").alias("label"))
        up = state.select(F.col("node").alias("label"), F.col("component").alias("upper"))
        state = replaced(state, spread.join(up, "label", "left").select("node", F.least("label", F.coalesce("upper", "label")).alias("component")))


def verdicts(documents: DataFrame) -> DataFrame:
    """id, mark, n_shingles, component, kept of every row of ``documents`` (doc_id, text)."""
    rows = stored(signatures(documents).withColumn("row", F.monotonically_increasing_id()))
    members = rows.where("cls is not null")
    nameless = F.when(F.col("id").isNull(), F.col("row"))
    classes = members.groupBy("cls").agg(F.min("id").alias("id"), F.min("mark").alias("mark"), F.first("sig").alias("sig"), F.min(nameless).alias("first"), F.count("*").alias("rows"))
    classes = stored(classes.withColumn("mark", F.when(F.col("id").isNull(), F.col("mark"))).withColumn("number", F.monotonically_increasing_id()))
    found = stored(lists(posted(classes.select(F.col("number").alias("id"), "sig"))))
    wanted = stored(classes.select("number", "id", "mark", "cls").join(found.select(F.col("id").alias("number")).distinct(), "number", "left_semi"))
    near = links(found, stored(sets(documents, wanted)))
    # a doc_id with several texts connects their classes
    h, t = F.xxhash64("cls"), F.xxhash64("cls", F.lit(1))
    named = members.where("id IS NOT NULL").groupBy("id").agg(F.min(h).alias("a"), F.max(h).alias("b"), F.min(t).alias("c"), F.max(t).alias("d")).where("a <> b OR c <> d").select("id")
    several = stored(members.join(named, "id", "left_semi").select("id", "cls").distinct().join(classes.select("cls", "number"), "cls").select("id", "number"))
    least = several.groupBy("id").agg(F.min("number").alias("least"))
    labels = components(near.unionAll(several.join(least, "id").select(F.col("number").alias("a"), F.col("least").alias("b"))))
    linked = classes.join(labels, F.col("number") == F.col("node"), "left").where("rows > 1 OR node IS NOT NULL").select("cls", "id", "first", F.coalesce("component", "number").alias("group"))
    groups = linked.groupBy("group").agg(F.min("id").alias("component"), F.min("first").alias("first"))
    of = stored(linked.select("cls", "group").join(groups, "group").select("cls", "component", "first", F.lit(True).alias("grouped")))
    stays = F.when(F.col("component").isNotNull(), F.col("id").eqNullSafe(F.col("component"))).otherwise(F.col("row") == F.col("first"))
    alone = F.col("grouped").isNull()
    return rows.join(of, "cls", "left").select("id", "mark", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"), F.when(alone, True).otherwise(stays).alias("kept"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``documents`` (doc_id, text)."""
    return verdicts(documents).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` of one document of each group of near-duplicates, that of the smallest doc_id, with all columns.

    Rows that share that doc_id stay together. Of a group without any doc_id one row stays.
    """
    id_, mark = spare(documents.columns, "__id"), spare(documents.columns, "__mark")
    found = stored(verdicts(documents))
    gone = stored(found.where("id IS NOT NULL AND NOT kept").select(F.col("id").alias(id_)).distinct())  # by its own size Spark sees whether the texts must move
    named = documents.where(F.col("doc_id").isNotNull()).join(gone, F.col("doc_id").cast("long") == F.col(id_), "left_anti")
    if found.where("id IS NULL").isEmpty():
        return named
    text = F.coalesce("text", F.lit(""))
    nameless = documents.where(F.col("doc_id").isNull()).withColumn(mark, F.sha2(text, 256))
    has_words = text.rlike(r"[^\x20\x09-\x0D]")
    stay = stored(found.where("id IS NULL AND n_shingles > 0 AND kept").select(F.col("mark").alias(mark)).distinct())
    one = nameless.where(has_words).dropDuplicates([mark]).join(stay, mark, "left_semi")
    return named.unionByName(nameless.where(~has_words).drop(mark)).unionByName(one.drop(mark))
