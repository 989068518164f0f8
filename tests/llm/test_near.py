"""Near-duplicates against all pairs."""

import random
import re

import pytest

from mossgraph.llm import minhash


def brute(rows):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()))
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and t and (i == j or 100 * len(s & t) >= 75 * len(s | t)):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i) if s else i, (root(i) if s else i) == i) for i, s in sets)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, component_id int, kept boolean").repartition(4)
    got = minhash.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(spark, rows)


@pytest.mark.parametrize("block", [512, 7])
def test_families(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(block)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    rows = []
    for family in range(6):
        base = [word() for _ in range(rng.choice([20, 80, 200]))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy + (passage if family % 2 else []))
    rows += [[word() for _ in range(90)] + passage for _ in range(60)]
    texts = [(n, " ".join(w)) for n, w in enumerate(rng.sample(rows, len(rows)))]
    texts += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "ÉÉ x"), (906, "éé x")]
    check(spark, texts)


def test_chains_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join(f"x{k}_{i}" if i >= 100 - 4 * k else base[i] for i in range(100)) for k in range(9)]
    check(spark, [(50 - k, t) for k, t in enumerate(chain)])
    check(spark, [(5, "a b c d e f g h"), (5, "q r s t u v w"), (9, "q r s t u v w"), (7, "a b c d e f g h"), (7, "a b c d e f g h")])


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "x"), (3, "a b c d e f", "y"), (4, "z", "z")], "doc_id long, text string, __id string")
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {None: (3, False), 3: (3, True), 4: (4, True)}
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()] == [3, 4]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.deduplicated(df.limit(0)).count() == 0


def test_null_ids_are_nodes_of_their_own(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    near = one.replace("a39", "other")
    rows = [(4, one), (5, two), (None, one), (None, two), (None, three), (None, three), (None, three.upper()), (None, None), (None, " "), (None, ""), (6, near)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, mark string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles > 0, str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    nameless = [("None", False, "None", True)] * 3 + [("None", True, "4", False), ("None", True, "5", False)] + [("None", True, "None", False)] * 2 + [("None", True, "None", True)]
    assert got == sorted([("4", True, "4", True), ("5", True, "5", True), ("6", True, "4", False), *nameless])
    kept = minhash.deduplicated(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["4", "5", *["None"] * 4]
    assert sum((r.text or "").lower() == three for r in kept) == 1


def test_near_copies_of_every_text_under_one_id(spark):
    rng, shared = random.Random(8), 5
    bases = [[f"t{k}_{i}" for i in range(120)] for k in range(6)]
    rows = [(shared, " ".join(b)) for b in bases]
    for k, b in enumerate(bases):
        copy = list(b)
        copy[rng.randrange(120)] = "changed"
        rows.append((100 + k, " ".join(copy)))
    rows.append((200, "quite another text of seven words"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {shared: (shared, True), 200: (200, True)} | {100 + k: (shared, False) for k in range(6)}
    check(spark, rows)
