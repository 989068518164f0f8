"""Secret scans by one combined deterministic automaton.

The rules' regular expressions (bytes; literals, classes, groups, alternation, ``? * + {m,n}``) are parsed into a
nondeterministic automaton, joined, made deterministic by subset construction over classes of equal bytes, minimised by
partition refinement and laid out as one transition array. A single pass over the bytes runs all rules at once, in many
lanes side by side: joined texts are cut at bytes from which every state returns to the start, so that no lane depends
on another; a long run without such a byte is cut anyhow, its lanes are run as functions of the state before them, and these are composed. The pass tells where matches end; a match's start comes from the rule's reversed automaton and its end from
the anchored one, walked over the few bytes of that match, leftmost and longest, without overlaps within a kind.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, spans

#: Kind, expression, least length of the whole match, and an expression whose group 1 has 6 characters at least.
BASE_RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0, r"""[^"':=\x20]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+", 20, ""),
    ("hex", r"[0-9a-f]{24,}", 24, ""),
)
#: Further kinds that the method adds.
MORE_RULES = (
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, ""),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, ""),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 40, ""),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15, ""),
    ("maps", r"AIza[0-9A-Za-z_-]+", 39, ""),
)
LANE, CHAIN, BATCH = 1024, 4096, 4 << 20
END = 0xFF  # stands between texts; never part of UTF-8


class _Parser:
    """Expression to tree: ('set', bytes), ('cat', ...), ('or', ...), ('rep', tree, least, most)."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        tree = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                stop = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : stop].partition(",")
                self.at = stop + 1
                tree = ("rep", tree, int(low), int(high) if high else None if comma else int(low))
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def atom(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            tree = self.either()
            assert self.take() == ")", self.text
            return tree
        if c == "[":
            return ("set", self.members())
        if c == ".":
            return ("set", frozenset(range(0xF8)) - {10})
        return ("set", frozenset([self.escaped() if c == "\\" else ord(c)]))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def members(self) -> frozenset[int]:
        negated = self.peek() == "^" and bool(self.take())
        found: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = high = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else ord(c)
            found.update(range(low, high + 1))
        self.take()
        return frozenset(set(range(0xF8)) - found if negated else found)


def parse(text: str):
    parser = _Parser(text)
    tree = parser.either()
    assert parser.at == len(text), text
    return tree


def mirrored(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "cat":
        return ("cat", [mirrored(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [mirrored(x) for x in tree[1]])
    return ("rep", mirrored(tree[1]), *tree[2:])


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, at: int) -> int:
        """Builds ``tree`` from state ``at``; returns where it ends."""
        if tree[0] == "set":
            to = self.state()
            self.moves[at].append((tree[1], to))
            return to
        if tree[0] == "cat":
            for part in tree[1]:
                at = self.add(part, at)
            return at
        if tree[0] == "or":
            ends = []
            for part in tree[1]:
                begin = self.state()
                self.empty[at].append(begin)
                ends.append(self.add(part, begin))
            to = self.state()
            for x in ends:
                self.empty[x].append(to)
            return to
        _, part, least, most = tree
        for _ in range(least):
            at = self.add(part, at)
        if most is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            return loop
        stops = [at]
        for _ in range(most - least):
            at = self.add(part, at)
            stops.append(at)
        to = self.state()
        for x in stops:
            self.empty[x].append(to)
        return to

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """State 0 is the start. ``step[state * 256 + byte]`` is the next state; ``accepts`` has a bit for each rule. In an anchored automaton ``dead`` is the state without a way on, else -1."""

    step: np.ndarray
    accepts: np.ndarray
    dead: int

    @property
    def resets(self) -> np.ndarray:
        """By byte: whether every state returns to the start."""
        return (self.step.reshape(-1, 256) == 0).all(0)


def compiled(trees: list, searching: bool) -> Automaton:
    """Subset construction and minimisation. ``searching``: matches may begin anywhere."""
    nfa = _Nfa()
    start = nfa.state()
    finals = {}
    for i, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[start].append(begin)
        finals[nfa.add(tree, begin)] = 1 << i
    signature = np.zeros((256, sum(map(len, nfa.moves))), bool)
    for k, (members, _) in enumerate(m for ms in nfa.moves for m in ms):
        signature[list(members), k] = True
    _, kinds = np.unique(signature, axis=0, return_inverse=True)
    kinds = kinds.ravel()
    sample = [int(np.flatnonzero(kinds == k)[0]) for k in range(kinds.max() + 1)]
    first = nfa.closed({start})
    number, order, rows = {first: 0}, [first], []
    for states in order:  # grows meanwhile
        by: dict[int, set[int]] = defaultdict(set)
        for s in states:
            for members, to in nfa.moves[s]:
                for k, b in enumerate(sample):
                    if b in members:
                        by[k].add(to)
        row = []
        for k in range(len(sample)):
            to = nfa.closed(by[k]) if k in by else frozenset()
            to = to | first if searching else to
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum({finals[s] for s in states if s in finals}) for states in order])
    part = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    names = {}
    for p in part:
        names.setdefault(int(p), len(names))  # the start comes first
    part = np.array([names[int(p)] for p in part])
    one = np.unique(part, return_index=True)[1]
    small = part[table[one]]
    assert len(one) < 1 << 16
    dead = -1 if searching else int(next((i for i in range(len(one)) if not accepts[one][i] and (small[i] == i).all()), -1))
    return Automaton(np.ascontiguousarray(small[:, kinds]).astype(np.uint32).ravel(), accepts[one].astype(np.uint32), dead)


class _Images(dict):
    """By byte: the states that any state can go to with it, and which of them each state goes to."""

    def __init__(self, automaton: Automaton) -> None:
        self.step = automaton.step.reshape(-1, 256)

    def __missing__(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        found, back = np.unique(self.step[:, byte], return_inverse=True)
        self[byte] = found, back.ravel()
        return self[byte]


class Scanner:
    """All rules compiled together, and each forwards and backwards."""

    def __init__(self, rules) -> None:
        self.rules = rules
        trees = [parse(r[1]) for r in rules]
        self.all = compiled(trees, True)
        self.onward = [compiled([t], False) for t in trees]
        self.back = [compiled([mirrored(t)], False) for t in trees]
        self.images = _Images(self.all)
        self.onward_steps, self.back_steps = ([x.step.tolist() for x in xs] for xs in (self.onward, self.back))
        self.inner = [re.compile(r[3].encode()) if r[3] else None for r in rules]
        assert self.all.resets[END]

    def entered(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """States in which lanes are entered. A lane that ``follows`` the one before it is entered in that one's last state, else at the start.

        Such chains are long runs without a reset. Each of their lanes is run from all states at once; states that have come
        together go on as one, so few are left after some bytes. The lanes' functions are then composed in order.
        """
        step, states = self.all.step, len(self.all.accepts)
        out = np.zeros(len(starts), np.uint32)
        chained = np.flatnonzero(follows | np.append(follows[1:], False))
        for at in range(0, len(chained), 64):
            some = chained[at : at + 64]
            begin, length = starts[some], (stops - starts)[some]
            after = [self.images[b] for b in raw[begin].tolist()]  # states after a lane's first byte, and which entry leads to which
            size = np.array([len(x) for x, _ in after])
            lane, state = np.repeat(np.arange(len(some)), size), np.concatenate([x for x, _ in after])
            shift, to = np.cumsum(size) - size, np.arange(size.sum())
            for t in range(1, int(length.max())):
                name = (state << np.uint32(8)) | raw[np.minimum(begin + t, len(raw) - 1)][lane]
                state = step[name] if t < length.min() else np.where(t < length[lane], step[name], state)
                if t < 64 and t % 4 == 0 or t == 256:
                    both, back = np.unique(lane.astype(np.int64) * states + state, return_inverse=True)
                    if len(both) < len(state):
                        lane, state, to = both // states, (both % states).astype(np.uint32), back.ravel()[to]
            for k, i in enumerate(some.tolist()):
                if i + 1 < len(starts) and follows[i + 1]:
                    out[i + 1] = state[to[shift[k] + after[k][1][out[i]]]]
        return out

    def ends(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte pass over joined texts: where runs of accepting states end, and the rules' bits there."""
        step, accepts = self.all.step, self.all.accepts
        cuts = np.flatnonzero(self.all.resets[raw]) + 1
        wanted = np.searchsorted(cuts, np.arange(LANE, len(raw), LANE))
        starts = np.unique(np.concatenate(([0], cuts[wanted[wanted < len(cuts)]])))
        starts = starts[starts < len(raw)]
        lengths = np.diff(np.append(starts, len(raw)))
        pieces = np.where(lengths < 2 * CHAIN, 1, lengths // CHAIN)
        offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, follows = np.repeat(starts, pieces) + offset * CHAIN, offset > 0
        stops = np.append(starts[1:], len(raw))
        state = self.entered(raw, starts, stops, follows) if follows.any() else np.zeros(len(starts), np.uint32)
        lengths = stops - starts
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, state = starts[order], lengths[order], state[order]
        live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        before = accepts[state]
        where, what = [], []
        for t, k in enumerate(live):
            at = starts[:k] + t
            s = step[(state[:k] << np.uint32(8)) | raw[at]]
            state[:k] = s
            now = accepts[s]
            over = before[:k] & ~now
            if over.any():
                i = np.flatnonzero(over)
                where.append(at[i])
                what.append(over[i])
            before[:k] = now
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        where, what = np.concatenate(where), np.concatenate(what)
        order = np.argsort(where, kind="stable")
        return where[order], what[order]

    def matches(self, rule: int, text: bytes, ends: list[int]) -> list[tuple[int, int]]:
        """Spans of one rule in one text, from where its accepting runs end."""
        onward, back = self.onward[rule], self.back[rule]
        forth_step, back_step = self.onward_steps[rule], self.back_steps[rule]
        goes, comes = onward.accepts.tolist(), back.accepts.tolist()
        least, inner = self.rules[rule][2], self.inner[rule]
        found, pos = [], 0
        for end in ends:
            if end <= pos:
                continue
            state, start, i = 0, -1, end - 1
            while i >= pos:
                state = back_step[state * 256 + text[i]]
                if state == back.dead:
                    break
                if comes[state]:
                    start = i
                i -= 1
            if start < 0:
                continue
            state, stop, i = 0, end, start
            while i < len(text):
                state = forth_step[state * 256 + text[i]]
                if state == onward.dead:
                    break
                i += 1
                if goes[state]:
                    stop = i
            pos = stop
            whole = text[start:stop]
            if len(whole) >= least and (inner is None or len(inner.fullmatch(whole)[1]) >= 6):
                found.append((start, stop))
        return found

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text: (start, rule, end) in code points, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        for a, b in spans([len(r) for r in raws], BATCH):
            stream = np.frombuffer(bytes([END]).join([*raws[a:b], b""]), np.uint8)
            stops = np.cumsum([len(r) + 1 for r in raws[a:b]])
            where, what = self.ends(stream)
            docs = np.searchsorted(stops, where, side="right")
            hits: dict[tuple[int, int], list[int]] = defaultdict(list)
            for at, bits, doc in zip(where.tolist(), what.tolist(), docs.tolist(), strict=True):
                begin = int(stops[doc]) - len(raws[a + doc]) - 1
                for rule in range(len(self.rules)):
                    if bits >> rule & 1:
                        hits[doc, rule].append(at - begin)
            for (doc, rule), ends in hits.items():
                raw = raws[a + doc]
                got = self.matches(rule, raw, ends)
                if got and len(raw) != len(texts[a + doc]):
                    points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to and with a byte
                    got = [(int(points[x]) - 1, int(points[y - 1])) for x, y in got]
                out[a + doc] += [(x, rule, y) for x, y in got]
        for x in out:
            x.sort()
        return out


_made: dict = {}


def scanner(rules) -> Scanner:
    """One compilation for each Python worker."""
    if rules not in _made:
        _made[rules] = Scanner(rules)
    return _made[rules]


def find(documents: DataFrame, more=MORE_RULES) -> DataFrame:
    """doc_id, spans (array of kind, start, end; code points, end exclusive) of every row of ``documents``.

    Null texts have no spans, nor have empty ones. Repeated rows and extra columns: each row is scanned, other columns
    are ignored. Very long texts are scanned whole, as one row of a batch. An empty table gives an empty result.
    """
    rules = BASE_RULES + tuple(more)
    kinds = [r[0] for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules).scan
        for batch in batches:
            got = scan(batch.column("text").to_pylist())
            rows = pa.array([[{"kind": kinds[r], "start": s, "end": e} for s, r, e in x] for x in got], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], ["doc_id", "spans"])

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.select("doc_id").schema.fields[0].dataType.simpleString()
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secrets(documents: DataFrame, more=MORE_RULES) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and text of all spans, for every document."""
    found = find(documents, more)
    base = [r[0] for r in BASE_RULES]
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(text(F.filter("spans", lambda x: x["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redacted(documents: DataFrame, more=MORE_RULES) -> DataFrame:
    """``documents`` with every secret in ``text`` replaced by ``[kind]``; overlapping spans are joined under the first one's kind. Null texts stay null."""
    rules = BASE_RULES + tuple(more)

    def clean(text: str, found: list[tuple[int, int, int]]) -> str:
        parts, at = [], 0
        for start, rule, end in found:
            if start >= at:
                parts += [text[at:start], f"[{rules[rule][0]}]"]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules).scan
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got = scan([t or "" for t in texts])
            cleaned = [t if not f else clean(t, f) for t, f in zip(texts, got, strict=True)]
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(cleaned, batch.schema.field(i).type))

    return documents.mapInArrow(frugal(run), documents.schema)
