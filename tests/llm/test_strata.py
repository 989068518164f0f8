import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mossgraph.llm import strata
from mossgraph.llm.queries import op13_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(documents, items, k=10):
    has = [(i, terms(t)) for i, t in documents]
    has = [(i, Counter(t), len(t)) for i, t in has if t]
    n, total = len(has), sum(x[2] for x in has)
    df = Counter(t for _, c, _ in has for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in has:
            m = 100 - 75 + 75 * size * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_tables(spark, sf):
    documents, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows(op13_ranked_search(spark, sf)) == sorted(plain(documents, items), key=str)


@pytest.fixture
def made():
    g = random.Random(8)
    vocabulary = ["".join(g.choices("abcXYZé0日_-", k=g.randint(1, 4))) for _ in range(60)]
    text = lambda n: " ".join(vocabulary[min(int(g.expovariate(0.08)), 59)] for _ in range(n))
    documents = [(i, text(g.choice([3, 3, 3, 20, 200]))) for i in range(300)]  # a third of the rows is one stratum or so
    documents += documents[:40] + [(7, "other text"), (1000, None), (1001, ""), (1002, " - "), (None, "abc abc"), (-5, "abc"), (1 << 62, "abc"), (2000, ("abc " * 5 + "Zz9 ") * 100_000)]
    items = [(i, text(9)) for i in range(12)] + [(20, "abc ABC abc"), (21, None), (22, "nowhereatall"), (23, ""), (24, "same"), (24, "same"), (25, "abc"), (25, "Zz9"), (None, "abc")]
    return documents, items


@pytest.mark.parametrize("limits", [{}, {"POSTINGS": 200, "DOCUMENTS": 50}, {"POSTINGS": 200, "QUERIES": 4, "FIRST": 1, "ASKED": 0}, {"PIECE": 3, "ASKED": 0}])
def test_odd_rows_and_cells_of_any_size(spark, monkeypatch, made, limits):
    for name, value in limits.items():
        monkeypatch.setattr(strata, name, value)
    documents, items = made
    of = lambda d, q: rows(strata.ranked(spark.createDataFrame(d, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("term", F.lit("x")).repartition(3), spark.createDataFrame(q, "item_id int, text string").withColumn("item", F.lit(2))))
    once = [(i, " ".join(sorted({t or "" for j, t in items if j == i}))) for i in dict.fromkeys(i for i, _ in items)]
    assert of(documents, items) == sorted(plain(documents, once), key=str)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    asks = lambda q: spark.createDataFrame(q, "item_id int, text string")
    assert rows(strata.ranked(none, asks([(1, "a")]))) == rows(strata.ranked(one, asks([]))) == rows(strata.ranked(none, asks([]))) == []
    assert rows(strata.ranked(one, asks([(1, "a")]))) == [(1, 1, 1, 287 * (10**9 // 1800))]


def test_stratum_bounds_prune():
    import pyarrow as pa

    g = random.Random(2)
    table = {c: [] for c in ("m", "term", "factor", "docs", "at")}
    for m in range(25, 125):
        table["m"].append(m)
        table["term"].append("a")
        table["factor"].append(10**9 // (1000 + 8 * m))
        table["docs"].append([m * 10 + j for j in range(10)])
        table["at"].append([(m - 25) * 10 + j for j in range(10)])
    cell = strata.Cell(pa.table({k: pa.array(v, pa.list_(pa.int64()) if k == "docs" else pa.list_(pa.int32()) if k == "at" else None) for k, v in table.items()}))
    ids, scores = cell.best(["a", "b"], [g.randint(5, 9), 3], 10, 0)
    assert list(ids) == list(range(250, 260)) and len(set(scores)) == 1
    assert cell.best(["a"], [5], 10, int(scores[0]) * 100)[0].size == 0
