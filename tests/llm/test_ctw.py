"""Scores against a plain context tree."""

import math
import zlib
from collections import Counter, defaultdict

from mossgraph.llm import ctw

END = bytes([255])


def plain(rows):
    """Base and model scores by dictionaries, over (context, bits) nodes."""
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    words = {i: b"".join(bytes([c + 32]) if 65 <= c <= 90 else bytes([c]) for c in (t or "").encode()).split() for i, t in rows}
    counts = Counter(w for i in train for w in [*words[i], None])
    total, distinct = sum(counts.values()), len(counts)
    tree = defaultdict(lambda: [0, 0])

    def steps(i):
        text = END * ctw.DEPTH + b" ".join(words[i]) + END
        for at in range(ctw.DEPTH, len(text)):
            bits = f"{text[at]:08b}"
            for b in range(8):
                yield [(text[at - d : at], bits[:b]) for d in range(ctw.DEPTH + 1)], int(bits[b])

    for i in train:
        for path, bit in steps(i):
            for node in path:
                tree[node][bit] += 1
    tree = dict(tree)
    own = {n: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for n, (a, b) in tree.items()}
    below, mixed = defaultdict(float), {}
    for (context, bits) in sorted(tree, key=lambda n: -len(n[0])):
        value = own[context, bits]
        if len(context) < ctw.DEPTH:
            x, y = math.log(0.5) + value, math.log(0.5) + below[context, bits]
            value = max(x, y) + math.log1p(math.exp(-abs(x - y)))
        mixed[context, bits] = value
        if context:
            below[context[1:], bits] += value
    out = {}
    for i, _ in rows:
        score = 0.0
        for path, bit in steps(i):
            p = None
            for node in reversed(path):
                if node in tree:
                    a, b = tree[node]
                    one = (b + 0.5) / (a + b + 1)
                    share = 1.0 if p is None else math.exp(math.log(0.5) + own[node] - mixed[node])
                    p = one if p is None else share * one + (1 - share) * p
            p = 0.5 if p is None else p
            score += math.log10(p if bit else 1 - p)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*words[i], None])
        out[i] = (len(words[i]) + 1, sum(counts[w] > 0 for w in [*words[i], None]), total, base, score)
    return out


def check(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(parts)
    want = plain(rows)
    got = ctw.scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and abs(r.score - score) < 1e-5 * max(1, -score), r


def test_against_a_plain_tree(spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text[:700]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect()]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "ÀB c"), (504, "xyzzy" * 30), (505, "ABC abc")]
    monkeypatch.setattr(ctw, "CHUNK", 3000)
    check(spark, rows)


def test_whole_texts(spark, sf, monkeypatch):
    """The longest documents and some others, whole, in chunks that a long text fills by itself."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").collect()]
    rows.sort(key=lambda r: (-len(r[1]), r[0]))
    long = [r for r in rows if len(r[1]) < 150_000][:2]
    monkeypatch.setattr(ctw, "CHUNK", 20_000)
    check(spark, long + rows[-12:])
    assert len(long[0][1]) > 10_000


def test_odd_tables(spark):
    check(spark, [(i, "only these words") for i in range(1)], 1)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.scores(none).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = ctw.scores(spark.createDataFrame([(i, "a b") for i in held], none.schema)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in got)
    twice = ctw.scores(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], none.schema)).collect()
    assert len(twice) == 3 and {r.doc_id for r in twice} == {1, None}
