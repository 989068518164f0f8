"""SentencePiece encoding and decoding by a max-plus parallel scan.

The encoding of a text is that of the vocabulary's own merges (a file of the merging kind): neighbouring symbols whose
concatenation is a piece are joined, the best score first, equal ones from the left. One space is put in front, and
decoding gives the text back exactly (spaces are U+2581 in pieces; a U+2581 of the text itself, and every character in
no piece, is spelt in byte pieces). The vocabulary's file is a parameter.

A segmentation is the merges' result if, and only if, the merges keep each two neighbouring pieces apart when they are
given just these two; so every prefix has one last piece. That makes the encoding a path over places whose steps depend
on the piece before, and a stretch of text a matrix over (max, +): its entry (i, j) is 0 where a path leads from
behind the i-th piece that can cross the stretch's first border to the j-th that can cross its last one, and minus
infinity where the merges would join what every such path keeps apart. Giant documents are split into chunks, each chunk's
matrix is computed by itself, matrices are combined by an associative scan, which tells by which piece each border is
crossed, and every chunk is then backtraced independently. Between two word borders inside a chunk, which no piece
crosses, words are merged side by side, once for each distinct word; so are documents of one chunk. Both ways
give the same pieces at every size of chunks.

Scale: chunks are rows, so a giant document is spread over tasks; what meets in one task for a document is a small matrix
for each chunk (a row and a column for each piece that fits over a border), not text. Only the vocabulary's path goes to tasks.

Null texts count as empty; an empty text has no pieces. Repeated rows and null ids are encoded each, very long words go by the same
matrices, an empty table gives an empty result, and other columns are carried along by ``encoded`` only if asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, spans, spare, stored

#: Characters of a chunk; a document of less than two chunks isn't split.
CHUNK = 1 << 14
BATCH = 1 << 20
#: Words and pairs of pieces whose results a task keeps.
KEPT, PAIRS = 1 << 17, 1 << 15
BLOCK = 16
_NONE = -1e30
_NO_RANK = 1 << 30


def default_model() -> str:
    """The path of the installed public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Vocabulary:
    """Pieces (with spaces as such), their ids and ranks (by score, the best first), and the pairs of symbols that merge, as one sorted array."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i).replace("▁", " ") for i in range(n)]
        self.bytes_of = [t.encode() for t in text]
        self.byte_id = [0] * 256
        self.ids: dict[str, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(text[i][3:5], 16)] = i
                self.bytes_of[i] = bytes([int(text[i][3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[text[i]] = i
        places = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: places[sp.get_score(i)] for p, i in self.ids.items()}
        self.width = max(map(len, self.ids), default=1)
        names = sorted(self.ids, key=len)
        names += sorted({c for p in names for c in p} - self.ids.keys())
        number = {s: k for k, s in enumerate(names, 1)}  # 0: a character in no piece
        self.id_of = np.array([-1, *(self.ids.get(s, -1) for s in names)], np.int64)
        self.symbol = np.zeros(0x110000, np.int32)
        for s, k in number.items():
            if len(s) == 1:
                self.symbol[ord(s)] = k
        pairs = {}
        for p in self.ids:
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    pairs[number[p[:k]] << 32 | number[p[k:]]] = (self.rank[p], number[p])
        keys = sorted(pairs)
        self.pairs = np.array([*keys, 1 << 62], np.int64)
        self.pair_rank = np.array([*(pairs[k][0] for k in keys), _NO_RANK], np.int64)
        self.pair_to = np.array([*(pairs[k][1] for k in keys), 0], np.int64)
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        assert not any(" " in p.lstrip(" ") for p in self.ids), "a piece crosses words"
        #: Words: spaces with what follows them, or a character that no longer piece holds. No piece crosses their borders.
        self.words = re.compile(f" +[^ {alone}]*|[^ {alone}]+" + (f"|[{alone}]" if alone else ""))
        self.cut = re.compile("(?<=[^ ])(?= )" + (f"|(?<=[{alone}])|(?=[{alone}])" if alone else ""))

    def merging(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of what pairs of symbols merge to."""
        name = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.pairs, name)
        at[self.pairs[at] != name] = len(self.pairs) - 1
        return self.pair_rank[at], self.pair_to[at]

    def merged(self, text: str) -> list[str]:
        """The merges' result for a short text."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, _NO_RANK) for a, b in zip(parts[:-1], parts[1:], strict=True)]
            best = min(ranks)
            if best == _NO_RANK:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def spelt(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacked matrices over (max, +)."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def scanned(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, in log n rounds (the product is associative)."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = max_plus(out[:-step], out[step:].copy())
        step *= 2
    return out


def borders(matrices: list[np.ndarray]) -> list[int]:
    """The states by which the borders before, between and after the stretches of ``matrices`` are crossed on the best path. A block of products is held at a time."""
    size = max(max(m.shape) for m in matrices)
    way, ways = np.full(size, _NONE), []
    way[0] = 0.0
    for at in range(0, len(matrices), BLOCK):
        some = np.full((min(BLOCK, len(matrices) - at), size, size), _NONE)
        for k, m in enumerate(matrices[at : at + BLOCK]):
            some[k, : m.shape[0], : m.shape[1]] = m
        ways += list((way[None, :, None] + scanned(some)).max(1))
        way = ways[-1]
    state = [int(np.argmax(ways[-1]))]
    assert ways[-1][state[0]] > _NONE / 2, "no path"
    for k in range(len(matrices) - 1, 0, -1):
        m = matrices[k]
        state.append(int(np.argmax(ways[k - 1][: len(m)] + m[:, state[-1]])))
    return [0, *reversed(state)]


class Encoder:
    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.kept, self.pairs = vocab, {}, {}

    # --- words, side by side ---
    def learn(self, words: set[str]) -> None:
        """Merges new words and keeps their ids."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        todo = [w for w in words if w not in self.kept]
        for a, b in spans([len(w) for w in todo], 1 << 18):
            self.kept.update(zip(todo[a:b], self.merge(todo[a:b]), strict=True))

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids (unsigned 32-bit) of words; every round merges one pair of each word that has one."""
        v, n = self.vocab, len(words)
        lens = np.array([len(w) for w in words])
        symbol = v.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word, start = np.repeat(np.arange(n), lens), np.arange(len(symbol))
        rank, to = np.full(len(symbol), _NO_RANK), np.zeros(len(symbol), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], to[inner] = v.merging(symbol[inner], symbol[inner + 1])
        done = []
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(symbol)))
            over = np.repeat(best == _NO_RANK, counts)
            if over.any():
                done.append((start[over], symbol[over], word[over]))
                live = ~over
                symbol, word, start, rank, to = symbol[live], word[live], start[live], rank[live], to[live]
                best, counts = best[best < _NO_RANK], counts[best < _NO_RANK]
            at = np.flatnonzero(rank == np.repeat(best, counts))
            at = at[np.concatenate(([True], word[at][1:] != word[at][:-1]))] if len(at) else at
            symbol[at] = to[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # places after the joined ones are gone
            symbol, word, start, rank, to = symbol[keep], word[keep], start[keep], rank[keep], to[keep]
            rank[at] = _NO_RANK
            near = np.concatenate([at, at[at > 0] - 1])
            near = near[near < len(symbol) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near], to[near] = v.merging(symbol[near], symbol[near + 1])
        start, symbol, word = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, int),) * 3
        order = np.argsort(start)
        start, ids, word = start[order], v.id_of[symbol[order]], word[order]
        cuts = np.searchsorted(word, np.arange(n + 1)).tolist()
        raw = ids.astype(np.uint32).tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        begins = np.cumsum(lens) - lens
        for k in np.unique(word[ids < 0]).tolist():  # words with characters that are no piece
            own, places = [], [*(start[cuts[k] : cuts[k + 1]] - begins[k]).tolist(), len(words[k])]
            for a, b in zip(places[:-1], places[1:], strict=True):
                own += v.spelt(words[k][a:b])
            out[k] = np.array(own, np.uint32).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (unsigned 32-bit) of whole texts."""
        out = []
        for a, b in spans([len(t) for t in texts], BATCH):
            words = [self.vocab.words.findall(" " + t) if t else [] for t in texts[a:b]]
            self.learn(set().union(*words))
            out += [b"".join([self.kept[w] for w in ws]) for ws in words]
        return out

    # --- chunks ---
    def apart(self, before: str, piece: str) -> bool:
        """Whether the merges leave these two pieces as they are (``before`` may be empty)."""
        key = before, piece
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.vocab.merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def crossing(self, text: str, border: int, last: bool = False) -> list[tuple[int, int]]:
        """States of a border: (overhang, length) of the pieces that fit over it or end at it, each beginning before it. The text's own end (``last``) is crossed by none."""
        v, out = self.vocab, []
        for over in range(1 if last else v.width):
            for size in range(over + 1, v.width + 1):
                a, b = border + over - size, border + over
                if a >= 0 and b <= len(text) and (size == 1 or text[a:b] in v.ids):
                    out.append((over, size))
        return out

    def path(self, text: str, at: int, size: int, stop: int, like: list[int] | None = None) -> list[int]:
        """For every place the length of the last piece there, from ``at``, where a piece of ``size`` ends (0: nothing goes before); 0 where there is none. ``like``: another path, which is followed from where both have been the same for the width of a piece."""
        v, last, same = self.vocab, [0] * (stop + 1), 0
        last[at] = size or -1
        for i in range(at + 1, stop + 1):
            for k in range(1, min(v.width, i - at) + 1):
                before = last[i - k]
                if before and (k == 1 or text[i - k : i] in v.ids) and self.apart(text[i - k - before : i - k] if before > 0 else "", text[i - k : i]):
                    last[i] = k
                    break
            if like is not None:
                same = same + 1 if like[i] == last[i] else 0
                if same >= v.width:
                    last[i:] = like[i:]
                    break
        return last

    @staticmethod
    def back(last: list[int], at: int, end: int) -> list[int]:
        """Ends of the pieces from ``at`` to ``end``, in order."""
        out = []
        while end > at:
            out.append(end)
            end -= last[end]
        return out[::-1]

    def cuts(self, own: str) -> tuple[int, int]:
        """The first and the last place inside a chunk that no piece crosses; (0, 0) if there is none."""
        found = [m.start() for m in self.vocab.cut.finditer(own, 1) if m.start() < len(own)]
        return (found[0], found[-1]) if found else (0, 0)

    def exits(self, text: str, last: list[int], states: list[tuple[int, int]], border: int) -> list[bool]:
        """Which states follow on a path."""
        out = []
        for over, size in states:
            a = border + over - size
            before = last[a] if a >= 0 else 0
            out.append(before != 0 and self.apart(text[a - before : a] if before > 0 else "", text[a : a + size]))
        return out

    def matrix(self, behind: str, own: str, ahead: str) -> np.ndarray:
        """A chunk's matrix between the states of its borders; a text begins without ``behind`` and ends without ``ahead``."""
        text, b0 = behind + own + ahead, len(behind)
        b1 = b0 + len(own)
        enter, leave = self.crossing(text, b0) if behind else [(0, 0)], self.crossing(text, b1, not ahead)
        out = np.full((len(enter), len(leave)), _NONE)
        p, q = self.cuts(own)
        if q:
            tail = self.exits(text, self.path(text, b0 + q, 0, b1), leave, b1)
        first = None
        for i, (over, size) in enumerate(enter):
            at = b0 + over
            if q:
                if at <= b0 + p and self.path(text, at, size, b0 + p)[b0 + p]:
                    out[i, tail] = 0.0
            else:
                last = self.path(text, at, size, b1, first)
                first = first or last
                out[i, self.exits(text, last, leave, b1)] = 0.0
        return out

    def trace(self, behind: str, own: str, ahead: str, enter: int, leave: int) -> tuple[bytes, str]:
        """Ids of a chunk between its known states, and the text that they stand for."""
        v, text, b0 = self.vocab, behind + own + ahead, len(behind)
        b1 = b0 + len(own)
        over, size = self.crossing(text, b0)[enter] if behind else (0, 0)
        beyond, final = self.crossing(text, b1, not ahead)[leave]
        at, stop = b0 + over, b1 + beyond - final
        p, q = self.cuts(own)
        out: list[bytes] = []

        def along(last: list[int], a: int, b: int) -> None:
            for end in self.back(last, a, b):
                out.append(np.array(v.spelt(text[end - last[end] : end]), np.uint32).tobytes())

        if q:
            along(self.path(text, at, size, b0 + p), at, b0 + p)
            words = v.words.findall(own[p:q])
            self.learn(set(words))
            out += [self.kept[w] for w in words]
            along(self.path(text, b0 + q, 0, b1), b0 + q, stop)
        else:
            along(self.path(text, at, size, b1), at, stop)
        out.append(np.array(v.spelt(text[stop : stop + final]), np.uint32).tobytes())
        return b"".join(out), text[at : b1 + beyond]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.bytes_of.__getitem__, np.frombuffer(ids, np.uint32).tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, with nothing kept from other tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(vocabulary(path))
    _encoders[path].kept.clear()
    _encoders[path].pairs.clear()
    return _encoders[path]


def _forgetting(run):
    """Frees what a task's encoder keeps when the task ends."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for code in _encoders.values():
                code.kept.clear()
                code.pairs.clear()

    return frugal(bounded)


def _types(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*columns).schema)


class _Parts:
    """Documents in two tables, with names that their own columns don't have."""

    def __init__(self, documents: DataFrame, path: str | None, columns: tuple[str, ...]) -> None:
        self.path, self.columns = path or default_model(), list(columns)
        self.text, self.row, self.m = (spare(columns, n) for n in ("__text", "__row", "__m"))
        docs = documents.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias(self.text))
        self.types = _types(docs, self.columns)
        self.small = docs.where(F.length(self.text) < 2 * CHUNK)
        self.large = docs.where(F.length(self.text) >= 2 * CHUNK)

    def chunks(self) -> DataFrame:
        """row (the document's number), ``columns``, part, parts, behind, own, ahead, enter, leave of the documents of several chunks."""
        path, columns, text, row, m = self.path, self.columns, self.text, self.row, self.m
        size = CHUNK

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, reach = TaskContext.get().partitionId() << 33, vocabulary(path).width
            for batch in batches:
                for i in range(batch.num_rows):
                    whole = " " + batch.column(text)[i].as_py()
                    parts = len(whole) // size
                    for k in range(parts):
                        a, b = k * size, (k + 1) * size if k + 1 < parts else len(whole)
                        own = [whole[max(0, a - reach) : a], whole[a:b], whole[b : b + reach]]
                        yield pa.RecordBatch.from_arrays([pa.array([number]), *(batch.column(c).slice(i, 1) for c in columns), pa.array([k], pa.int32()), pa.array([parts], pa.int32()), *(pa.array([x], pa.string()) for x in own)], [row, *columns, "__part", "__parts", "__behind", "__own", "__ahead"])
                    number += 1

        def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code = encoder(path)
            for batch in batches:
                got = [code.matrix(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("__behind", "__own", "__ahead")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(row), batch.column("__part"), pa.array([x.shape[1] for x in got], pa.int32()), pa.array([x.tobytes() for x in got], pa.binary())], [row, "__part", "__width", m])

        def combined(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("__part")
            at = borders([np.frombuffer(x.as_py()).reshape(-1, w) for x, w in zip(rows.column(m), rows.column("__width").to_pylist(), strict=True)])
            return pa.table([rows.column(row), rows.column("__part"), pa.array(at[:-1], pa.int32()), pa.array(at[1:], pa.int32())], [row, "__part", "__enter", "__leave"])

        made = stored(self.large.mapInArrow(frugal(split), f"`{row}` long, {self.types}__part int, __parts int, __behind string, __own string, __ahead string"))
        each = made.select(row, "__part", "__behind", "__own", "__ahead").repartition(F.col(row), F.col("__part")).mapInArrow(_forgetting(matrices), f"`{row}` long, __part int, __width int, `{m}` binary")
        found = each.groupBy(row).applyInArrow(combined, f"`{row}` long, __part int, __enter int, __leave int")
        return made.join(found, [row, "__part"])

    def whole(self, schema: str, names: list[str], make) -> DataFrame:
        """Rows of documents of one chunk: ``columns`` and what ``make`` gives for encoder, ids and text, as ``names``."""
        path, columns, text = self.path, self.columns, self.text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code = encoder(path)
            for batch in batches:
                for a, b in spans([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)], BATCH):
                    part = batch.slice(a, b - a)
                    texts = part.column(text).to_pylist()
                    yield _batch(part, columns, [make(code, ids, " " + t if t else "", 0, 1) for ids, t in zip(code.encode(texts), texts, strict=True)], names)

        return self.small.mapInArrow(_forgetting(run), self.types + schema)

    def traced(self, schema: str, names: list[str], make) -> DataFrame:
        """Rows of chunks: row, ``columns`` and what ``make`` gives, as ``names``."""
        path, columns = self.path, [self.row, *self.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code = encoder(path)
            for batch in batches:
                got = []
                for behind, own, ahead, enter, leave, k, n in zip(*(batch.column(c).to_pylist() for c in ("__behind", "__own", "__ahead", "__enter", "__leave", "__part", "__parts")), strict=True):
                    got.append(make(code, *code.trace(behind, own, ahead, enter, leave), k, n))
                yield _batch(batch, columns, got, names)

        return self.chunks().mapInArrow(_forgetting(run), f"`{self.row}` long, {self.types}{schema}")


_KINDS = {"part": pa.int32(), "parts": pa.int32(), "ids": pa.list_(pa.int32()), "n_pieces": pa.int64(), "raw": pa.binary(), "ids_sha256": pa.string(), "round_trip": pa.bool_()}


def _batch(batch: pa.RecordBatch, columns: list[str], rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(c, _KINDS[n]) for c, n in zip(cols, names, strict=True))], [*columns, *names])


def encoded(documents: DataFrame, path: str | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, part, parts and ids of every document; a document of several chunks has a row for each, part 0, 1, ... . ``columns`` must not be named like these three."""
    parts = _Parts(documents, path, columns)
    make = lambda code, ids, text, k, n: (k, n, np.frombuffer(ids, np.int32))
    schema, names = "part int, parts int, ids array<int>", ["part", "parts", "ids"]
    return parts.whole(schema, names, make).unionAll(parts.traced(schema, names, make).drop(parts.row))


def decoded(rows: DataFrame, path: str | None = None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns``, part and the bytes of every row of ``encoded``; a document's text is that of its parts in order, less the space in front."""
    path = path or default_model()
    columns = [*columns, "part"]
    kept = rows.select(*columns, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            yield _batch(batch, columns, [(code.decode(np.array(x.as_py() or [], np.uint32).tobytes()),) for x in batch.column("ids")], ["raw"])

    return kept.mapInArrow(frugal(run), _types(kept, columns) + "raw binary")


def summaries(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the document's ids, each of 4 bytes, little-endian, whatever its number of chunks), round_trip (whether the ids decode to the text) of every document.

    Rows of documents of one chunk stand as they are; parts of giant documents are put together by row and run through
    the digest in order, batch by batch, so repeated rows and null ids keep a row each.
    """
    parts = _Parts(documents, path, ("doc_id",))
    right = lambda code, ids, text: code.decode(ids) == text.encode("utf-8", "surrogatepass")
    one = parts.whole("n_pieces long, ids_sha256 string, round_trip boolean", ["n_pieces", "ids_sha256", "round_trip"], lambda code, ids, text, k, n: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), right(code, ids, text)))
    several = parts.traced("part int, raw binary, round_trip boolean", ["part", "raw", "round_trip"], lambda code, ids, text, k, n: (k, ids, right(code, ids, text)))
    row = parts.row

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc, digest, n, right_ = None, None, None, 0, True

        def over() -> pa.RecordBatch:
            return _batch(doc, ["doc_id"], [(n, digest.hexdigest(), right_)], ["n_pieces", "ids_sha256", "round_trip"])

        for batch in batches:
            for i, at in enumerate(batch.column(row).to_pylist()):
                if at != now:
                    if doc is not None:
                        yield over()
                    now, doc, digest, n, right_ = at, batch.select(["doc_id"]).slice(i, 1), hashlib.sha256(), 0, True
                ids = batch.column("raw")[i].as_py()
                digest.update(ids)
                n, right_ = n + len(ids) // 4, right_ and batch.column("round_trip")[i].as_py()
        if doc is not None:
            yield over()

    together = several.repartition(F.col(row)).sortWithinPartitions(row, "part").mapInArrow(frugal(joined), parts.types + "n_pieces long, ids_sha256 string, round_trip boolean")
    return one.unionAll(together)
