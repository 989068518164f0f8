"""Classifiers: held-out accuracy and odd inputs."""

import math
import re
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mossgraph.llm import ftrl, subwords

DOCS = "doc_id long, text string, score double"


def data(spark, n=400):
    docs = [(i, " ".join(["plain", "words", f"w{i % 37}", "here"] * (i % 5 + 1)) + (" idiot scum" if i % 2 else " nice friend"), 0.5) for i in range(n)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, int(i % 2 == 0), i % 2) for i in range(n)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = data(spark)
    for got, label in ((subwords.quality(docs, labels, bits=12), "quality"), (ftrl.toxicity(docs, labels, bits=14), "toxic")):
        rows = got.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
        assert len(rows) > 50 and np.mean([p == y for p, y in rows]) > 0.97


def test_fit_holds_its_sample_once(spark, monkeypatch):
    docs, labels = data(spark)
    tables, alive, train, to_arrow = [], [], subwords.train, type(docs).toArrow

    def fetched(df):
        got = to_arrow(df)
        tables.append(weakref.ref(got))
        return got

    def seen(*args):
        alive.append(sum(t() is not None for t in tables))
        return train(*args)

    monkeypatch.setattr(type(docs), "toArrow", fetched)
    monkeypatch.setattr(subwords, "train", seen)
    assert subwords.fit(docs, labels, bits=12).weights.any()
    assert len(tables) == 1 and alive == [0]


def test_odd_rows(spark):
    _, labels = data(spark)
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (2, "", 0.2), (None, "scum idiot", 0.0), (4, "x" * 1_300_000 + " scum", 0.3)], DOCS)
    labelled, _ = data(spark)
    both = labelled.unionAll(docs)
    bad = labels.unionAll(spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0)], labels.schema))
    for got in (subwords.quality(both, bad, bits=12), ftrl.toxicity(both, bad, bits=14)):
        rows = got.collect()
        assert len(rows) == 405 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        null, empty = (next(r.score for r in rows if r.doc_id == k) for k in (1, 2))
        assert isinstance(null, float) and isinstance(empty, float)
    assert subwords.quality(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in ftrl.toxicity(docs, labels.limit(0)).collect()} == {0.5}


M64 = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def word_hash(codes):
    return mix(sum(mix(c + 1) * pow(subwords.BASE, i, 1 << 64) for i, c in enumerate(codes)) & M64)


def toxic_slots(text, bits):
    """Slots of words, stems, pairs and skip pairs, one word at a time."""
    words = re.findall(rb"[0-9a-z\x80-\xfe]+", (text or "").lower().encode())
    h = [word_hash(w) for w in words]
    out = {x >> 64 - bits for x in h}
    for w in words:
        out |= {mix(word_hash(w[:n]) + n & M64) >> 64 - bits for n in (4, 5, 6) if len(w) > n}
    for gap, salt in ftrl.GAPS:
        out |= {mix((a * 31 + salt & M64) ^ b) >> 64 - bits for a, b in zip(h, h[gap:], strict=False)}
    return sorted(out)


WORDS = st.one_of(st.sampled_from(["", " ", "  ", ". ", "a", "É", "日本", "idiot", "Scum"]), st.integers(1, 9000).map(lambda n: "xy" * n))


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=14), st.sampled_from([8, 50, 5000]))
@example(["xy" * 9000], 50)
@example(["xy" * 9000, " ", "xy" * 9000, " a"], 5000)
def test_long_texts_have_the_features_of_short_ones(parts, size):
    text = "".join(parts)
    grams, whole = ftrl.Grams(20), ftrl.SLICE
    want = set(np.concatenate([grams(*ftrl.joined([text]))[0]]).tolist())
    if len(text) < 2000:
        assert want == set(toxic_slots(text, 20))
    ftrl.SLICE = size
    try:
        assert {x for got in grams.of_long(text) for x in got.tolist()} == want
    finally:
        ftrl.SLICE = whole


def plain_ftrl(rows, bits, epochs=8, alpha=0.3, beta=1.0, l1=6.0, l2=1.0, seed=11):
    """The learner by dictionaries, one coordinate at a time."""
    z, n, bias = defaultdict(float), defaultdict(float), 1 << bits
    count = [sum(y == k for y, _ in rows) for k in (0, 1)]

    def weight(i):
        lasso = 0.0 if i == bias else l1
        return 0.0 if abs(z[i]) <= lasso else -(z[i] - math.copysign(lasso, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, slots = rows[k]
            at = [*slots, bias]
            g = (1 / (1 + math.exp(-sum(map(weight, at)))) - y) * len(rows) / 2 / count[y]
            for i in at:
                w = weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w
                n[i] += g * g
    return lambda slots: 1 / (1 + math.exp(-sum(map(weight, [*slots, bias]))))


def test_toxicity_against_a_plain_learner(spark):
    docs, labels = data(spark, 90)
    odd = spark.createDataFrame([(1000, None, 0.0), (1001, "", 0.0), (1001, "", 0.0), (1002, "scum " * 9, 0.0)], DOCS)
    texts, y = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    train = sorted((y[i], np.array(toxic_slots(t, 14), np.uint32).tobytes()) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 3 != 1)
    score = plain_ftrl([(y, np.frombuffer(s, np.uint32).tolist()) for y, s in train], 14)
    got = ftrl.toxicity(docs.unionAll(odd), labels, bits=14).collect()
    assert len(got) == 94
    for r in got:
        want = score(toxic_slots({**texts, 1000: "", 1001: "", 1002: "scum " * 9}[r.doc_id], 14))
        assert abs(r.score - want) < 1e-5 and r.predicted == (want >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def quality_slots(text, bits):
    """Counts of the slots of words and n-grams, one at a time."""
    codes, out = [ord(c) for c in text or ""], Counter()
    for n in (3, 4):
        for i in range(len(codes) - n + 1):
            h = n * 0x01000193
            for j in range(n):
                h = h + codes[i + j] * int(subwords._MULTIPLIERS[j]) & 0xFFFFFFFF
                h ^= h >> 15
            out[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 32 - bits] += 1
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        out[word_hash([ord(c) for c in w]) >> 64 - bits] += 1
    return out


def plain_embeddings(rows, share, bits, dim=8, epochs=12, rate=2.0, batch=16, seed=7):
    """Mini-batch descent by loops; ``rows``: label and counts of slots."""
    rng = np.random.default_rng(seed)
    v = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32).astype(float)
    w, b, step = np.zeros((2, dim)), np.zeros(2), 0
    count = [sum(y == k for y, _ in rows) for k in (0, 1)]
    steps = epochs * math.ceil(len(rows) / batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            lr, gw, gb, gv, size = rate * (1 - step / steps), np.zeros((2, dim)), np.zeros(2), [], len(order[at : at + batch])
            for k in order[at : at + batch]:
                y, slots = rows[k]
                total = sum(slots.values())
                h = sum((v[s] * (c / total) for s, c in slots.items()), np.zeros(dim))
                z = w @ h + b
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                p[y] -= 1
                p = p * (share if y else 1 - share) * len(rows) / count[y]
                gw, gb = gw + np.outer(p, h) / size, gb + p / size
                gv += [(s, p @ w * (c / total)) for s, c in slots.items()]
            w, b, step = w - lr * gw, b - 0.1 * lr * gb, step + 1
            for s, g in gv:
                v[s] -= lr * g
    return lambda slots: 1 / (1 + math.exp(-sum((v[s] @ (w[1] - w[0]) * c for s, c in slots.items()), 0.0) / max(sum(slots.values()), 1) - (b[1] - b[0])))


def test_quality_against_plain_descent(spark):
    docs, labels = data(spark, 60)
    odd = spark.createDataFrame([(1000, None, 0.0), (1001, "", 0.0), (1001, "", 0.0), (1002, "é 日本 scum", 0.0)], DOCS)
    texts, y = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    train = []
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 0:
            c = quality_slots(t, 10)
            slots = np.array(sorted(c), np.uint32)
            x = np.array([c[s] for s in slots.tolist()], np.float32)
            train.append((y[i], slots.tobytes(), (x / x.sum()).astype(np.float32).tobytes()))
    rows = [(y, dict(zip(np.frombuffer(s, np.uint32).tolist(), np.frombuffer(x, np.float32).tolist(), strict=True))) for y, s, x in sorted(train)]
    score = plain_embeddings(rows, np.mean([y for y, _ in rows]), 10)
    for r in subwords.quality(docs.unionAll(odd), labels, bits=10).collect():
        want = score(quality_slots({**texts, 1000: "", 1001: "", 1002: "é 日本 scum"}[r.doc_id], 10))
        assert abs(r.score - want) < 1e-3 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)


def test_slices_give_the_same_scores(monkeypatch):
    text = " ".join(f"word{i % 91} a{i}" for i in range(4000))
    model = subwords.Model(12, np.random.default_rng(0).normal(size=1 << 12).astype(np.float32), 0.1)
    weights = np.random.default_rng(1).normal(size=1 << 14).astype(np.float32)
    linear = ftrl.Model(14, np.arange(1 << 14, dtype=np.uint64), weights / 100, 0.1)
    whole = model.scorer()([text])[0], linear.scorer()([text])[0]
    monkeypatch.setattr(subwords, "SLICE", 1 << 14)
    monkeypatch.setattr(ftrl, "SLICE", 5000)
    cut = model.scorer()([text])[0], linear.scorer()([text])[0]
    assert abs(whole[0] - cut[0]) < 1e-3  # words at a cut are hashed in parts
    assert abs(whole[1] - cut[1]) < 1e-6


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i % 40, "word " * (i % 7 + 1) + str(i), 0.0) for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    rows, share = subwords.labelled_sample(labels, docs, "quality", 5, 0, 100, 1 << 20)
    got = rows.collect()
    fold = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert len(got) == len(fold) and share == np.mean([i % 2 for i in fold])  # one text for each id
    few = subwords.labelled_sample(labels, docs, "quality", 5, 0, 3, 1 << 20)[0].collect()
    assert sorted(r.y for r in few) == [0] * 3 + [1] * 3
    short = subwords.labelled_sample(labels, docs, "quality", 5, 0, 100, 200)[0].collect()
    assert 0 < len(short) < len(fold) and sum(len(r.text) for r in short) <= 200


def test_accepting_keeps_columns(spark):
    docs, labels = data(spark)
    docs = docs.withColumns({"__text": F.lit("x"), "__SCORE": F.lit(1)})
    got = subwords.accepted(docs, labels, bits=12)
    assert got.schema == docs.schema and 150 < got.count() < 250


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = subwords.quality(docs, labels).join(labels, "doc_id").where("quality = 1").agg(F.avg("predicted")).first()
    assert rows[0] > 0.97
