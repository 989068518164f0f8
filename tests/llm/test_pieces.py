"""Encodings against plain merges and the library's own, chunks against whole texts, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st

from mossgraph.llm import pieces

MODEL = pieces.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
VOCAB = pieces.vocabulary(MODEL)
CODE = pieces.Encoder(VOCAB)
#: A character in no piece takes the place of U+2581, which the library reads as a space.
FOREIGN = ""


def plain(text):
    """Merges of the whole text, one at a time."""
    if not text:
        return []
    if len(text) > 200:  # no merge crosses a word's border
        words, at = VOCAB.words.findall(" " + text), []
        for w in words:
            at += plain_word(w)
        return at
    return plain_word(" " + text)


def plain_word(text):
    parts = [c if c != "▁" else FOREIGN for c in text]
    while True:
        ranks = [VOCAB.rank.get(a + b, 1 << 30) for a, b in zip(parts[:-1], parts[1:], strict=True)]
        if not ranks or min(ranks) == 1 << 30:
            return [i for p in parts for i in VOCAB.spelt(p if p != FOREIGN else "▁")]
        k = ranks.index(min(ranks))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def numbers(raw):
    return np.frombuffer(raw, np.uint32).tolist()


TEXTS = st.text(st.sampled_from("abthe  \n▁é𝄞\t.日quickおund=-0"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=4))
@example(["", "a" * 40, " " * 37, "====----", "\x00\n \n"])
def test_merges_and_round_trip(texts):
    for text, ids in zip(texts, CODE.encode(texts), strict=True):
        assert numbers(ids) == plain(text)
        assert CODE.decode(ids).decode() == (" " + text if text else "")
        if "▁" not in text:
            assert numbers(ids) == LIBRARY.encode(text)


def cut(raw, size):
    n, w = max(1, len(raw) // size), VOCAB.width
    ends = [k * size for k in range(n)] + [len(raw)]
    return [(raw[max(0, a - w) : a], raw[a:b], raw[b : b + w]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abthe  \n▁é.日quicknasios=-"), min_size=1, max_size=80), st.integers(1, 4), st.integers(17, 60))
@example("x" * 48, 3, 17)
@example("a    aaa   a aaaa a      a aaa", 3, 17)
@example(" " * 33, 4, 20)
@example("ab\n" * 20, 2, 18)
def test_chunks_give_the_pieces_of_whole_texts(text, times, size):
    text *= times
    parts = cut(" " + text, size)
    at = pieces.borders([CODE.matrix(*c) for c in parts])
    got = [CODE.trace(*c, e, f) for c, e, f in zip(parts, at[:-1], at[1:], strict=True)]
    assert numbers(b"".join(x for x, _ in got)) == plain(text)
    assert "".join(t for _, t in got) == " " + text


def test_every_prefix_has_one_last_piece():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices(rng.choice(["abthe in ", "    x", "aaab=- ", "日本é\n x."]), k=rng.randrange(1, 30)))
        last = [-1] + [0] * len(text)
        for i in range(1, len(text) + 1):
            fits = [k for k in range(1, min(VOCAB.width, i) + 1) if last[i - k] and (k == 1 or text[i - k : i] in VOCAB.ids) and CODE.apart(text[i - k - last[i - k] : i - k] if last[i - k] > 0 else "", text[i - k : i])]
            assert len(fits) == 1
            last[i] = fits[0]


def test_products_are_associative():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(37, 4, 4))
    one = m[0]
    for k, got in enumerate(pieces.scanned(m)):
        one = m[0] if k == 0 else pieces.max_plus(one, m[k])
        assert np.allclose(one, got)
    shapes = [1, 3, 2, 4, *[3] * 30, 2]
    ways = [rng.normal(size=(a, b)) for a, b in zip(shapes[:-1], shapes[1:], strict=True)]
    at = pieces.borders(ways)
    best = ways[0]
    for x in ways[1:]:
        best = pieces.max_plus(best, x)
    assert at[0] == 0 and np.isclose(sum(x[a, b] for x, a, b in zip(ways, at[:-1], at[1:], strict=True)), best.max())


def test_documents_as_the_library_has_them(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in pieces.summaries(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = LIBRARY.encode(text)
        assert (got[i].n_pieces, got[i].ids_sha256, got[i].round_trip) == (len(ids), hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest(), True)


@pytest.mark.parametrize("size", [40, 300, 1 << 14])
def test_tables(spark, sf, monkeypatch, size):
    monkeypatch.setattr(pieces, "CHUNK", size)
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(25).collect()]
    rows += [(1000, None), (1001, ""), (1002, "x" * 2000), (1003, "ab▁c  d\n"), (1003, "ab▁c  d\n"), (1004, " ".join(rng.choices(["the", "quick", "brown▁", "日本"], k=900)))]
    docs = spark.createDataFrame([(i, t, "p", 3, 4) for i, t in rows], "doc_id long, text string, ids string, n_pieces int, __text int").repartition(3)
    got = pieces.summaries(docs).collect()
    want = sorted((i, len(plain(t)), hashlib.sha256(np.array(plain(t), np.uint32).tobytes()).hexdigest(), True) for i, t in ((i, t or "") for i, t in rows))
    assert sorted(tuple(r) for r in got) == want  # the same at every size of chunks
    parts = pieces.decoded(pieces.encoded(docs, columns=("doc_id", "__text")), columns=("doc_id", "__text")).collect()
    back = {}
    for r in sorted(parts, key=lambda r: (r.doc_id, r.part)):
        back[r.doc_id] = back.get(r.doc_id, b"") + r.raw
    for i, t in rows:
        if i != 1003:
            assert back[i].decode() == (" " + t if t else "")
    assert pieces.summaries(docs.limit(0)).count() == 0


def test_repeated_and_null_ids_of_giant_rows(spark, monkeypatch):
    rng = random.Random(2)
    one, two = (" ".join(rng.choices(["the", "quickest", "aaaaaaaaaaaaaaaaaaaaaaa", "日本"], k=300)) for _ in range(2))
    rows = [(7, one), (7, one), (7, two), (None, one), (None, two), (8, "short"), (8, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((str(i), len(plain(t))) for i, t in rows)
    for size in (100, 300, 1 << 14):
        monkeypatch.setattr(pieces, "CHUNK", size)
        got = pieces.summaries(docs).collect()
        assert sorted((str(r.doc_id), r.n_pieces) for r in got) == want and all(r.round_trip for r in got)
