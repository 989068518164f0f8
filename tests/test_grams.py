"""Counting and hashing of n-grams in numbers, against plain versions."""

import math
import tracemalloc

import numpy as np
import pytest

from mossgraph.functions import text
from mossgraph.functions.hashing import gram_hash


def texts():
    rng = np.random.default_rng(8)
    letters = list("abcdé ß😀́")
    out = ["", "a", "ab", "abc abc abc", "abcd abcde abcdef x", "a\0b\0c d", "".join(map(chr, range(0x4E00, 0x4E00 + 5000))), "x" * 4000]
    return out + [" ".join("".join(rng.choice(letters, 40)).split()) for _ in range(40)]


def test_numbers_of_grams():
    for t in texts():
        counts = text._gram_counts(t)
        assert text._gram_number(t) == (sum(counts.values()), len(counts))


def test_a_batch_of_texts_is_not_held_as_grams(spark):
    rng = np.random.default_rng(9)
    words = ["".join(map(chr, rng.integers(97, 123, 8))) for _ in range(4000)]
    long = [" ".join(rng.choice(words, 12000)) for _ in range(4)]
    tracemalloc.start()
    for t in long:
        text._gram_number(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * max(map(len, long))  # arrays of one text; no string for every gram of a batch
    rows = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert {r.doc_id: (r.n, r.n_distinct) for r in text.gram_numbers(rows).collect()} == {i: text._gram_number(t) for i, t in enumerate(long)}


@pytest.mark.parametrize("most, known", [(1 << 20, 1 << 19), (300, 64)])
def test_hashes_of_texts(monkeypatch, most, known):
    monkeypatch.setattr(text, "MOST_TEXT", most)
    monkeypatch.setattr(text, "MOST_KNOWN", known)
    monkeypatch.setattr(text, "MOST_GRAMS", known)
    asked = []

    def place(gram):
        asked.append(gram)
        h = gram_hash(42, True)(gram)
        return h % 384, 1.0 if (h // 384) % 2 == 0 else -1.0

    given = texts()
    made = text._Hashed(place, 384)
    got = {at + i: (s, m) for at, sums, met in made.of(given) for i, (s, m) in enumerate(zip(sums, met, strict=True))}
    assert len(got) == len(given)
    for k, t in enumerate(given):
        want, met = np.zeros(384), np.zeros(384, bool)
        for g, n in text._gram_counts(t).items():
            slot, sign = place(g)
            want[slot] += sign * n
            met[slot] = True
        assert (got[k][0] == want).all() and (got[k][1] == met).all()


def test_a_gram_is_hashed_once_in_a_task():
    asked = []
    made = text._Hashed(lambda g: (asked.append(g) or (hash(g) % 7, 1.0)), 7)
    for _ in range(3):
        list(made.of(["the cat sat on the mat"] * 5))
    grams = text._gram_counts("the cat sat on the mat")
    assert len(asked) <= len(grams) + len(set("the cat sat on the mat".split())) and set(asked) == set(grams)


def test_unit_length(spark):
    rows = spark.createDataFrame([(1, "call 555-123-4567 now"), (2, ""), (3, None)], "doc_id long, text string")
    u = {r.doc_id: r.u for r in text.hash_vectors(rows).collect()}
    assert math.isclose(sum(x * x for x in u[1]), 1) and not any(u[2]) and not any(u[3])
