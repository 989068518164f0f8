import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgraph.llm import whitening
from mossgraph.llm.queries import op11_whitening


def plain(vectors):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    z = x.astype(float) - np.array([t / n for t in s])
    cov = z.T @ z / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    return deviation, z, cov, e, v


def by_row(rows):
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_every_vector_equals_a_plain_version(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, z, cov, e, v = plain([r.embedding for r in table])
    got = by_row(op11_whitening(spark, sf).collect())
    assert len(got) == len(table)
    w = np.array([[got[r.vec_id][c].whitened for c in range(1, 9)] for r in table])
    want = z @ v[:, :8] / np.sqrt(e[:8])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-7  # one sign a component
    assert [got[r.vec_id][3].deviation for r in table] == list(deviation)
    first = got[table[0].vec_id]
    assert first[1].n == len(table) and first[1].identity_error < 1e-9
    assert np.allclose([first[c].explained for c in range(1, 9)], e[:8] / np.trace(cov), rtol=1e-10)


@pytest.mark.parametrize("kind", ["random", "close", "repeated", "deficient", "one", "huge", "steep"])
def test_splitting(kind):
    g = np.random.default_rng(5)
    n = 1 if kind == "one" else 40
    q = np.linalg.qr(g.standard_normal((n, n)))[0]
    e = {"random": g.random(n) * 9, "close": 1 + 1e-9 * np.arange(n), "repeated": np.repeat([5.0, 5, 2, 1], n // 4), "deficient": np.r_[3.0, 2, 1, np.zeros(max(n - 3, 0))], "one": np.array([4.0]), "huge": 1e17 * g.random(n), "steep": 10.0 ** -np.arange(n)}[kind]
    a = q * e @ q.T
    values, axes = whitening.components(a, 8)
    want = np.sort(e)[::-1][: len(values)]
    assert len(values) == min(8, n)
    assert np.allclose(values, want, atol=1e-13 * np.abs(e).max() * n)
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-13 * n
    assert np.abs(a @ axes - axes * values).max() <= 1e-13 * n * np.abs(e).max()


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 0.5], 7), (1, [1.0, 2.0, 0.5], 7), (None, [3.0, -1.0, 0.25], 7), (2, None, 7), (3, [1.0, None, 2.0], 7), (4, [1.0, float("nan"), 2.0], 7), (5, [float("inf"), 1.0, 1.0], 7), (6, [4.0], 7), (7, [0.0, 9.0, -2.0], 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long").withColumn("component", F.lit("x")).withColumn("w", F.lit(1))
    got = whitening.whitened(table).collect()
    used = [[1, 2, 0.5], [1, 2, 0.5], [3, -1, 0.25], [4, 0, 0], [0, 9, -2]]
    deviation, z, cov, e, v = plain(used)
    assert sorted(map(str, {r.vec_id for r in got})) == ["1", "6", "7", "None"] and len(got) == 15 and {r.n for r in got} == {5}
    assert {r.vec_id: r.deviation for r in got} == {1: deviation[0], None: deviation[2], 6: deviation[3], 7: deviation[4]}
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == 1), sorted(abs(z @ v[:, 0] / np.sqrt(e[0]))))


def test_flat_empty_and_far_vectors(spark):
    of = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert of([]) == [] and of([(1, [])]) == [] and of([(1, None)]) == []
    flat = of([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in flat] == [(None, 0.0, 0, None)] * 4
    line = {(r.vec_id, r.component): r for r in of([(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [3.0, 3.0])])}
    assert line[1, 2].whitened is None and abs(abs(line[1, 1].whitened) - 1.5**0.5) < 1e-9 and line[1, 1].explained > 1 - 1e-12 and line[2, 1].identity_error < 1e-9
    far = of([(1, [3e38, 0.0]), (2, [-3e38, 1.0])])
    assert {r.deviation for r in far} == {(1 << 63) - 1} and all(abs(abs(r.whitened) - 1) < 1e-6 for r in far if r.component == 1)


def test_parts_of_any_number_agree(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    a, b = (by_row(whitening.whitened(table.repartition(k)).collect()) for k in (1, 7))
    sign = {c: np.sign(a[0][c].whitened * b[0][c].whitened) for c in a[0]}
    assert all(abs(a[i][c].whitened - sign[c] * b[i][c].whitened) < 1e-7 for i in a for c in a[i])
