"""Ranked lexical search by a length-stratified index.

A document's normaliser m is a whole number that depends on its length alone, so documents of equal m form a stratum. In a
stratum the postings of a term lie by tf, and as m is one number there, a term's impact is computed once for each tf. A
query's bound for a stratum is what its terms make of the highest tf there; strata are visited in falling order of their
bounds, until a bound is below the k-th score.

On Spark: one pass over the texts keeps the terms that any query asks for. Rows are then dealt out by ranges of (m, hash of
the row), which are cells of about ``POSTINGS`` postings; a stratum too large for a cell goes on in the next one. A query
first visits the cell with its highest bound, whose k-th score rules out other cells before their postings are read again;
cells that are left are visited with that score as the floor, and strata within a cell by their own bounds.

Scale: query terms are sent to all tasks while they have ``ASKED`` bytes at most; beyond that documents' terms find them by a
join. Queries are dealt out in blocks of ``QUERIES``. The tasks of a cell return k rows a query, of which a window keeps the best.
Terms are maximal runs of ASCII letters, digits and characters above U+007F, with only A-Z lower-cased.

Nulls: a null text has no terms. A document without doc_id counts in N, L and df, but isn't ranked, as no result could name
it. Items: repeated rows count once, different texts of one item_id as one text; a null item_id is an id of its own; an
item without terms, or whose terms are in no document, has no rows. Repeated documents are ranked each. Texts are read whole,
in pieces of ``PIECE`` bytes. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, stored

K = 10
POSTINGS, DOCUMENTS, QUERIES, ASKED, PIECE = 1 << 19, 1 << 16, 4096, 1 << 24, 1 << 20
#: Documents of the strata that are scored at once, at first; twice as many each time.
FIRST = 512
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes) -> Counter:
    """The terms of a text in UTF-8, counted."""
    found, at = Counter(), 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _LETTERS[text[end]] != 32:
            end += 1
        found.update(text[at:end].translate(_LETTERS).split())
        at = end
    return found


def counted(rows: DataFrame, key: str, asked: frozenset[bytes] | None = None) -> DataFrame:
    """``key`` as long, ``n`` (terms with repeats) and the arrays ``terms`` and ``tfs`` of every row with a term; of ``asked`` terms only, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, terms, tfs, offsets = [], [], [], [], [0]
            for name, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                has = words(text.as_py() or b"")
                if has:
                    keys.append(name.as_py())
                    sizes.append(has.total())
                    mine = has.keys() if asked is None else has.keys() & asked
                    terms += mine
                    tfs += map(has.__getitem__, mine)
                    offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *lists], [key, "n", "terms", "tfs"])

    return rows.select(F.col(key).cast("long").alias(key), "text").mapInArrow(frugal(run), f"{key} long, n long, terms array<string>, tfs array<long>")


def asked_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, item: a number) and their terms (item, term, qtf)."""
    texts = items.select("item_id", "text").distinct().groupBy("item_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("text"))
    numbered = stored(texts.withColumn("item", F.monotonically_increasing_id()))
    pairs = counted(numbered, "item").select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    return numbered.drop("text"), stored(pairs.select("item", F.col("p.terms").alias("term"), F.col("p.tfs").alias("qtf")))


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, n, terms, tfs of every document with a term; of its terms those of the table ``terms`` (term)."""
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if size <= ASKED:
        return stored(counted(documents, "doc_id", frozenset(r.term.encode() for r in terms.collect())))
    every = stored(counted(documents, "doc_id").withColumn("row", F.monotonically_increasing_id()))
    each = every.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    mine = each.join(terms, "term", "left_semi").groupBy("row").agg(F.collect_list(F.struct("term", "tf")).alias("p"))
    lists = (F.coalesce(f"p.{c}", F.array().cast(f"array<{kind}>")).alias(name) for c, kind, name in (("term", "string", "terms"), ("tf", "long", "tfs")))
    return stored(every.select("row", "doc_id", "n").join(mine, "row", "left").select("doc_id", "n", *lists))


def index(posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index (cell, m, term, tf, factor, docs, at) over all documents with an id, and terms' weights (term, w).

    ``factor`` is an impact without the term's weight; ``at`` has the documents' places in their cell, by m and id.
    """
    n, total, pairs = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    df = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = df.select("term", F.floor(1000 * F.log((2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long").alias("w"))
    cells = max(1, -(-pairs // POSTINGS), -(-n // DOCUMENTS))
    m = F.expr(f"100 - 75 + ((75 * cast(n AS decimal(12,0)) * cast({n} AS decimal(18,0))) div cast({max(total, 1)} AS decimal(20,0)))").cast("long").alias("m")
    held = posted.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).select("doc_id", m, "terms", "tfs")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cell, parts = TaskContext.get().partitionId(), list(batches)
        rows = pa.Table.from_batches(parts) if parts else None
        if rows is None or not rows.num_rows:
            return
        rows = rows.sort_by([("m", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        ids, ms = (rows.column(c).to_numpy() for c in ("doc_id", "m"))
        place = np.repeat(np.arange(len(ids), dtype=np.int32), pc.list_value_length(rows.column("terms")).to_numpy())
        names = pc.list_flatten(rows.column("terms")).combine_chunks().dictionary_encode()
        names, term = names.dictionary, names.indices.to_numpy()
        tf = pc.list_flatten(rows.column("tfs")).to_numpy()
        order = np.lexsort((place, tf, term, ms[place]))
        place, term, tf = place[order], term[order], tf[order]
        stratum = ms[place]
        starts = np.flatnonzero(np.r_[True, (np.diff(stratum) != 0) | (np.diff(term) != 0) | (np.diff(tf) != 0)])
        ends = np.r_[starts[1:], len(place)]
        for a in range(0, len(starts), 4096):
            s, e = starts[a : a + 4096], ends[a : a + 4096]
            cut = slice(s[0], e[-1])
            off = pa.array(np.r_[s, e[-1]] - s[0], pa.int32())
            impact = 1_000_000_000 * tf[s] // (1000 * tf[s] + 8 * stratum[s])
            lists = (pa.ListArray.from_arrays(off, pa.array(x)) for x in (ids[place[cut]], place[cut]))
            columns = pa.array(np.full(len(s), cell, np.int32)), pa.array(stratum[s]), names.take(pa.array(term[s])), pa.array(tf[s]), pa.array(impact)
            yield pa.RecordBatch.from_arrays([*columns, *lists], ["cell", "m", "term", "tf", "factor", "docs", "at"])

    dealt = held.repartitionByRange(cells, "m", F.xxhash64("doc_id"))
    return stored(dealt.mapInArrow(build, "cell int, m long, term string, tf long, factor long, docs array<long>, at array<int>")), stored(weights)


class Cell:
    """The strata of a cell, ready to be searched."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        self.sizes = pc.list_value_length(rows.column("at")).to_numpy()
        at, docs = (pc.list_flatten(rows.column(c)).to_numpy() for c in ("at", "docs"))
        ms, row_stratum = np.unique(rows.column("m").to_numpy(), return_inverse=True)
        self.ids = np.zeros(at.max(initial=-1) + 1, np.int64)
        self.ids[at] = docs
        self.stratum = np.zeros(len(self.ids), np.int64)
        self.stratum[at] = np.repeat(row_stratum, self.sizes)
        self.members = np.bincount(self.stratum, minlength=len(ms))
        self.factor, self.row_stratum = rows.column("factor").to_numpy(), row_stratum
        first = np.r_[0, np.cumsum(self.sizes)]
        names = rows.column("term").combine_chunks().dictionary_encode()
        codes = names.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
        self.terms = {}
        for mine in np.split(order, cuts[1:]):
            place = np.concatenate([at[first[r] : first[r + 1]] for r in mine])
            self.terms[names.dictionary[int(codes[mine[0]])].as_py()] = mine, place, self.stratum[place]

    def best(self, terms: list[str], weights: list[int], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents whose score is ``floor`` at least and above 0."""
        mine = [(self.terms[t], w) for t, w in zip(terms, weights, strict=True) if t in self.terms and w > 0]
        bounds = np.zeros(len(self.members), np.int64)
        for (rows, _, _), w in mine:
            top = np.zeros(len(bounds), np.int64)
            np.maximum.at(top, self.row_stratum[rows], self.factor[rows])
            bounds += w * top
        impacts = [np.repeat(w * self.factor[rows], self.sizes[rows]) for (rows, _, _), w in mine]
        turn = np.argsort(-bounds, kind="stable")
        reach = np.cumsum(self.members[turn])
        ids, scores, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), max(floor, 1)
        a, want = 0, FIRST
        while a < len(turn) and bounds[turn[a]] >= floor:
            b = int(np.searchsorted(reach, (reach[a - 1] if a else 0) + want)) + 1
            now = turn[a:b][bounds[turn[a:b]] >= floor]
            chosen = np.zeros(len(bounds), bool)
            chosen[now] = True
            total = np.zeros(len(self.ids), np.int64)
            for ((_, place, stratum), _), impact in zip(mine, impacts, strict=True):
                use = chosen[stratum]
                total[place[use]] += impact[use]
            good = np.flatnonzero(total >= floor)
            ids, scores = np.r_[ids, self.ids[good]], np.r_[scores, total[good]]
            order = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[order], scores[order]
            if len(scores) == k:
                floor = max(floor, int(scores[-1]))
            a, want = b, 2 * want
        return ids, scores


def visited(index_: DataFrame, visits: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each cell for the items of ``visits`` (cell, block, item, floor)."""
    lists = asked.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("p")).select("item", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"))
    right = visits.join(lists, "item").select(F.col("cell").alias("c"), F.col("block").alias("b"), "item", "floor", "terms", "weights").groupBy("c", "b")
    left = index_.join(visits.select("cell", "block").distinct(), "cell").drop("tf").groupBy("cell", "block")

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        items, ids, scores = [], [], []
        if rows.num_rows and asks.num_rows:
            cell = Cell(rows)
            for q in asks.to_pylist():
                got = cell.best(q["terms"], q["weights"], k, q["floor"])
                items.append(np.full(len(got[0]), q["item"], np.int64))
                ids.append(got[0])
                scores.append(got[1])
        return pa.table({n: np.concatenate([np.zeros(0, np.int64), *x]) for n, x in (("item", items), ("doc_id", ids), ("score", scores))})

    return left.cogroup(right).applyInArrow(run, "item long, doc_id long, score long")


def ranked(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest score above 0, ties to the smaller doc_id."""
    numbered, pairs = asked_terms(items)
    parts, weights = index(postings(documents, pairs.select("term").distinct()))
    asked = stored(pairs.join(weights, "term").select("item", "term", (F.col("qtf") * F.col("w")).alias("weight")))
    blocks = max(1, -(-numbered.count() // QUERIES))
    summary = parts.groupBy("cell", "term").agg(F.max("factor").alias("factor"))
    bounds = asked.join(summary, "term").groupBy("item", "cell").agg(F.sum(F.col("weight") * F.col("factor")).alias("bound"))
    turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "cell"))
    visits = stored(bounds.select("item", "cell", "bound", turn.alias("turn"), F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")))
    first = stored(visited(parts, visits.where("turn = 1").select("cell", "block", "item", F.lit(1).cast("long").alias("floor")), asked, k))
    least = first.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    later = visits.where("turn > 1").join(least, "item", "left").withColumn("floor", F.coalesce("least", F.lit(1))).where(F.col("bound") >= F.col("floor"))
    found = first.unionByName(visited(parts, later.select("cell", "block", "item", "floor"), asked, k))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    best = found.select("item", "doc_id", "score", rank.cast("int").alias("rank")).where(F.col("rank") <= k)
    return best.join(numbered, "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT item_id, string_agg(text, ' ' ORDER BY text) AS text FROM (SELECT DISTINCT item_id, text FROM benchmark) GROUP BY item_id),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b),
q AS (SELECT item_id, term, count(*) AS qtf FROM i GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(t)) AS total FROM d WHERE len(t) > 0),
n AS (SELECT row_number() OVER () AS row, doc_id, t, 100 - 75 + ((75 * len(t)::HUGEINT * n_docs) // total)::BIGINT AS m FROM d, s WHERE len(t) > 0),
p AS (SELECT row, doc_id, m, term, count(*) AS tf FROM (SELECT row, doc_id, m, unnest(t) AS term FROM n) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
r AS (SELECT item_id, doc_id, row, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) WHERE doc_id IS NOT NULL GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
