"""The cone of the outputs against the whole graph, and products in pieces."""

import tracemalloc

import numpy as np
import pytest

from mossgraph.operators import reservoir


def test_products_take_bounded_memory():
    rng = np.random.default_rng(1)
    m, n, cols = 300_000, 2_000, 64
    g = reservoir.Compressed(rng.integers(0, n, m), np.minimum(rng.integers(0, 2 * n, m), n - 1), rng.normal(size=m), n)  # the last node has half of all edges
    x = rng.normal(size=(n, cols))
    tracemalloc.start()
    z = g.incoming(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 < m * cols * 8
    rows, first, src, w = g.strips[0]
    assert np.allclose(z[rows[3]], (x[src[first[3] : first[4]]] * w[first[3] : first[4], None]).sum(0))
    assert np.allclose(z[n - 1], (x[src[first[-1] :]] * w[first[-1] :, None]).sum(0))
    assert np.allclose(g.incoming(x[:, :1]), z[:, :1])


@pytest.fixture(scope="module")
def network(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 400, (1600, 2))} | {(k, 7) for k in range(50)})
    edges = spark.createDataFrame([(a * 3, b * 3, float(rng.normal())) for a, b in pairs] + [(0, 21, 0.5), (9999, 3, 1.0), (3, 9999, 1.0)], "src long, dst long, w double")
    return spark.createDataFrame([(k * 3,) for k in range(400)], "node long"), edges


@pytest.mark.parametrize("local", [True, False])
def test_equals_the_whole_graph(spark, network, monkeypatch, local):
    nodes, edges = network
    if not local:
        monkeypatch.setattr(reservoir, "CONE_EDGES", 1600)  # found by joins: the graph has more than a quarter
    rng = np.random.default_rng(6)
    inside = edges.where("src <> 9999 AND dst <> 9999")
    g, names = reservoir.compressed(inside, nodes)
    for inputs, outputs, steps, per_step in ((50, 5, 4, True), (20, 3, 4, False), (400, 9, 3, False), (1, 2, 2, True)):
        u = rng.normal(size=(6, steps, 4) if per_step else (6, 4))
        examples = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], f"id long, u {'array<array<double>>' if per_step else 'array<double>'}")
        ins, outs = reservoir.picked_roles(names, 42, inputs, outputs)
        want = {r.id: r for r in reservoir.batch_states(examples, g, reservoir.input_weights(len(names), ins, 4, 0.7), steps, 0.3, 0.02, outs, washout=1).collect()}
        made = reservoir.coned(edges, nodes, inputs, outputs, 4, 0.7, steps)
        assert len(made[0].nodes) < 400 or inputs == 400
        got = {r.id: r for r in reservoir.cone_states(examples, made, steps, 0.3, 0.02, washout=1).collect()}
        assert got.keys() == want.keys()
        for i, r in want.items():
            assert np.allclose(got[i]["mean"], r["mean"], atol=1e-12) and np.allclose(got[i]["last"], r["last"], atol=1e-12)
            assert 0 <= got[i].least <= r.energy + 1e-12
        assert inputs != 50 or max(r.least for r in got.values()) > 0


def test_energies_below_the_bound_are_whole(spark, network):
    nodes, edges = network
    rows = spark.createDataFrame([(1, [1.0, -2.0]), (2, [0.0, 0.0]), (3, [1e-7, 1e-7])], "id long, u array<double>")
    args = (edges.where("src <> 9999 AND dst <> 9999"), nodes, 50, 5, 2, 0.7, 4, 0.3, 0.02, "id")
    want = {r.id: r for r in reservoir.states(rows, *args).collect()}
    got = {r.id: r for r in reservoir.states(rows, *args, least=1e-5).collect()}
    assert want.keys() == got.keys() and all(np.allclose(got[i]["last"], r["last"], atol=1e-12) for i, r in want.items())
    assert got[2].energy == 0 and np.isclose(got[3].energy, want[3].energy) and 1e-5 < got[1].energy <= want[1].energy


def test_cases_of_one_kind_run_once(spark, sf, monkeypatch):
    from mossgraph.plans import model_queries, service_queries

    seen = []
    heard = service_queries._heard
    monkeypatch.setattr(service_queries, "_heard", lambda u, *a: seen.append(u.count()) or heard(u, *a))
    rows = service_queries.village_hear(spark, sf).count()
    c = model_queries.cases(spark, sf)
    assert rows == c.where("split = 'holdout'").count() and seen == [c.select(*service_queries.facts.FIELDS).distinct().count()]
