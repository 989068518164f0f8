"""Invariants: direction, controls, lesions, both forms of propagation, files, generators, streams."""

import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from mossgraph.functions import hashing, text, vectors
from mossgraph.operators import controls, evaluation, facts, graph, guards, learning, reservoir
from mossgraph.sources import generators, sinks, tables
from mossgraph.streaming import streams


@pytest.fixture(scope="module")
def ring(spark):
    nodes = spark.range(80).select(F.col("id").alias("node"), (F.col("id") % 4).cast("string").alias("region"))
    edges = nodes.select(F.col("node").alias("src"), F.explode(F.array(F.struct(F.pmod(F.col("node") + 1, F.lit(80)).alias("dst"), F.lit(1.0).alias("w")), F.struct(F.pmod(F.col("node") + 7, F.lit(80)).alias("dst"), F.lit(0.5).alias("w")))).alias("e")).select("src", "e.dst", "e.w")
    return nodes, edges.cache()


def test_activity_flows_from_source_to_destination(spark):
    edges = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, w double")
    start = spark.createDataFrame([(0, 1.0), (1, 0.0)], "node long, x double")
    got = {r.node: r.x for r in reservoir.step(start, edges, leak=1.0).collect()}
    assert got[0] == 0.0 and abs(got[1] - np.tanh(1.0)) < 1e-12
    off = reservoir.step(start, edges, leak=1.0, disabled=spark.createDataFrame([(1,)], "node long"))
    assert {r.x for r in off.collect()} == {0.0}


def test_both_forms_agree(spark, ring):
    nodes, edges = ring
    g, names = reservoir.compressed(edges, nodes)
    inputs, outputs = reservoir.picked_roles(names, 3, 10, 20)
    assert not set(inputs) & set(outputs)
    win = reservoir.input_weights(80, inputs, 5, 1.15)
    rows = [(k, np.random.default_rng(k).normal(size=5).tolist()) for k in range(4)]
    got = {r.id: r for r in reservoir.batch_states(spark.createDataFrame(rows, "id long, u array<double>"), g, win, 4, 0.28, 0.7, np.arange(80), batch=3).collect()}
    for k, u in rows:
        drive = spark.createDataFrame([(names[i], float(win[i] @ u)) for i in range(80)], "node long, u double")
        want = {r.node: r.x for r in reservoir.run(nodes.select("node", F.lit(0.0).alias("x")), edges, drive, 4, leak=0.28, scale=0.7).collect()}
        assert np.allclose(got[k].last, [want[n] for n in names], atol=1e-9)


def test_controls_keep_what_they_must(spark, ring):
    nodes, edges = ring
    weights = sorted(r.w for r in edges.collect())
    pairs = lambda df: [(r.src, r.dst) for r in df.collect()]
    for name in controls.CONTROLS:
        made = controls.control(name, edges, nodes, 3)
        assert sorted(r.w for r in made.collect()) == weights and len(pairs(made)) == 160
    erdos = pairs(controls.random_erdos(edges, nodes, 3))
    assert len(set(erdos)) == 160 and all(a != b for a, b in erdos)
    swapped = controls.degree_preserving(edges, 5, rounds=2)
    ends = pairs(swapped)
    assert len(set(ends)) == 160 and all(a != b for a, b in ends) and set(ends) != set(pairs(edges))
    assert sorted(map(tuple, graph.degrees(swapped).select("node", "out_degree", "in_degree").collect())) == sorted(map(tuple, graph.degrees(edges).select("node", "out_degree", "in_degree").collect()))
    assert sorted(pairs(controls.random_weights(edges, 1))) == sorted(pairs(edges))
    with pytest.raises(ValueError):
        controls.control("unknown", edges, nodes)
    with pytest.raises(ValueError):
        controls.random_erdos(edges, nodes.limit(5))


def test_lesions(spark, ring):
    nodes, edges = ring
    assert controls.how_many(80, 0.001) == 1 and controls.how_many(80, 0.0) == 0
    gone = {r.node for r in controls.lesion_nodes("remove_fraction", edges, nodes, 0.1, seed=1).collect()}
    left = controls.cut(edges, spark.createDataFrame([(g,) for g in gone], "node long")).collect()
    assert len(gone) == 8 and all(r.src not in gone and r.dst not in gone for r in left)
    moved = controls.randomise_region(edges, nodes, "1", 2)
    before, after = ({(r.src, r.w) for r in df.collect() if r.src % 4 == 1} for df in (edges, moved))
    assert before == after and moved.count() == 160 and moved.where("src = dst").count() == 0
    assert moved.select("src", "dst").distinct().count() == 160


def test_spectral_scale(spark, ring):
    nodes, edges = ring
    r = reservoir.spectral_scale(edges, nodes.select("node", F.lit(1.0).alias("x")), 0.9, 5).first()
    assert abs(r.radius - 1.5) < 1e-9 and abs(r.factor - 0.6) < 1e-9
    none = reservoir.spectral_scale(edges.limit(0), nodes.select("node", F.lit(1.0).alias("x")), 0.9, 2).first()
    assert none.factor == 1.0


def test_text(spark):
    row = spark.createDataFrame([("Contact alex@example.com at 555-123-4567 A b",)], "text string")
    got = row.select(text.redacted(F.col("text")).alias("r"), text.normalised(F.col("text")).alias("n"), hashing.fnv1a(F.lit("a")).alias("h")).first()
    assert "@" not in got.r and not any(c.isdigit() for c in got.r) and got.n.endswith("a b") and got.h == 3826002220
    unit = row.select(vectors.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), vectors.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("s")).first()
    assert unit.u == [0.6, 0.8] and unit.s == [0.5, 0.5]


def test_labels_and_statistics(spark):
    one = spark.range(1)
    with pytest.raises(Exception, match="unknown label"):
        one.select(evaluation.multi_hot(F.array(F.lit("nope")))).collect()
    assert one.select(evaluation.multi_hot(F.array().cast("array<string>")).alias("h")).first().h[0] == 1
    trials = spark.createDataFrame([(d * 2 + g, d, m, 0.8 + (0.1 if m == "connectome" else 0.0)) for d in range(4) for g in range(2) for m in ("connectome", "linear")], "pair_id int, data_seed int, model string, macro_f1 double")
    means = evaluation.cluster_means(evaluation.paired_deltas(trials, "connectome", "linear"))
    p, ci = evaluation.sign_permutation(means).first(), evaluation.bootstrap(means, 200).first()
    assert p.clusters == 4 and abs(p.p_value - 0.125) < 1e-12 and abs(ci.low - 0.1) < 1e-9
    assert spark.range(1).select(evaluation.verdict(F.lit(ci.low), F.lit(ci.high), F.lit(p.p_value)).alias("v")).first().v == "inconclusive"


def test_facts_abstain_on_silence(spark):
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.9), (2, "b", 0.1)], "case_id int, label string, p double")
    energy = spark.createDataFrame([(1, 1.0), (2, 0.0)], "case_id int, energy double")
    got = {r.case_id: (r.action, r.reason) for r in facts.recommended(scores, "case_id", energy).collect()}
    assert got == {1: ("abstain", "ambiguous"), 2: ("abstain", "silent")}


def test_ridge_and_logistic(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    rows = spark.createDataFrame([(i, v.tolist(), float(v @ [1, -2, 0.5]), [int(v[0] > 0)]) for i, v in enumerate(x)], "id int, u array<double>, y double, t array<int>")
    assert np.allclose([r.weight for r in learning.ridge(spark, rows, "u", "y").orderBy("i").collect()], [1, -2, 0.5], atol=1e-4)
    p = {r.id: r.p[0] for r in learning.logistic_readout(rows, "id", "u", "t", 1).collect()}
    assert np.mean([(p[i] > 0.5) == (v[0] > 0) for i, v in enumerate(x)]) > 0.97


def test_admission(spark):
    rows = spark.createDataFrame([(1, 1, "2020-01-01 00:00:00"), (1, 2, "2020-01-01 00:00:30"), (1, 3, "2020-01-01 00:00:59"), (1, 4, "2020-01-01 00:01:01"), (2, 5, "2020-01-01 00:00:00")], "user_id int, event_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: r.admitted for r in guards.admitted(rows, "user_id", "event_id", "ts", 2, 60.0).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_files(spark, ring, tmp_path):
    nodes, edges = ring
    sinks.save_graph(nodes, edges, {"science_version": "2"}, str(tmp_path / "g"))
    n, e, meta = tables.graph(spark, str(tmp_path / "g"))
    assert n.count() == 80 and e.count() == 160 and meta["science_version"] == "2"
    raw = tables.GRAPH_MAGIC + struct.pack("<II", 2, 1) + struct.pack("<III", 0, 1, 1) + struct.pack("<I", 1) + struct.pack("<f", 2.0)
    (tmp_path / "b.bin").write_bytes(raw)
    assert [tuple(r) for r in tables.binary_graph(spark, str(tmp_path / "b.bin")).collect()] == [(0, 1, 2.0)]
    (tmp_path / "bad.bin").write_bytes(raw[:-4] + struct.pack("<f", -2.0))
    with pytest.raises(Exception, match="wrong connections"):
        tables.binary_graph(spark, str(tmp_path / "bad.bin")).collect()
    (tmp_path / "c.csv").write_text("bodyId_pre,bodyId_post,weight\na,b,3\na,z,9\nb,a,1\n")
    (tmp_path / "n.csv").write_text("bodyId,type,instance\na,KCx,\nb,,i\n")
    known = tables.neurons(spark, str(tmp_path / "n.csv"))
    assert [tuple(r) for r in tables.connections(spark, str(tmp_path / "c.csv"), known).collect()] == [("a", "b", 3.0)]
    assert {r.node: r.cell_type for r in known.collect()} == {"a": "KCx", "b": "unknown"}
    listed = spark.createDataFrame([(0, "x", "y", None), (1, "y", "z", 2.0)], "position long, pre_id string, post_id string, weight double")
    got, linked = tables.edge_list(listed)
    assert sorted(tuple(r) for r in got.collect()) == [("x", 0), ("y", 1), ("z", 2)] and linked.count() == 2
    assert tables.resolve(known, ("CELL_TYPE",)) == "cell_type"


def test_generators(spark, tmp_path):
    rows = generators.split(spark, "hard", 120, 5)
    assert rows.collect() == generators.split(spark, "hard", 120, 5).collect() and rows.count() == 120
    assert {x for r in rows.limit(11).collect() for x in r.labels} == set(evaluation.LABELS[1:])
    nodes, edges = generators.modular_graph(spark, 64)
    assert nodes.count() == 64 and edges.select("src", "dst").distinct().count() == edges.count() <= 512
    sinks.save_splits(generators.data_set(spark, "base").withColumn("n", F.length("text")), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).groupBy("split").count().count() == 3


def test_streams(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = streams.activity(stream, late="400 days").writeStream.outputMode("complete").format("memory").queryName("act").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = source.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert spark.table("act").agg(F.count("*"), F.sum("n")).first() == want.agg(F.count("*"), F.sum("n")).first()
    q = streams.admitted(stream, 1, 3600.0).writeStream.outputMode("append").format("memory").queryName("adm").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("adm").collect()) == sorted(guards.admitted(source, "user_id", "event_id", "ts", 1, 3600.0).collect())


def test_generations(spark, tmp_path):
    g = streams.Generations()
    old, new = g.begin(), g.begin()
    assert not g.publish(old, spark.range(1), str(tmp_path)) and g.publish(new, spark.range(1), str(tmp_path))


def test_vectorised_states_belong_to_their_nodes(spark):
    from mossgraph import catalog

    got, want = ({r.node: r.x for r in catalog.queries()[q](spark, "/root/testdata/sf0.1").collect()} for q in ("reservoir_vectorised", "reservoir_4step"))
    assert len(want) > 3000 and got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 2e-6


def test_whole_texts_in_noise_and_hashes(spark, tmp_path):
    import hashlib

    from mossgraph import catalog

    texts = ["x" * 64 + "a", "x" * 64 + "b", "Straße. Ab  c,d"] + ["Ab  c,d. é ß"] * 8
    spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hashed = {r.doc_id: r.h for r in catalog.queries()["fnv1a_document"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        h = 2166136261
        for c in t:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        assert hashed[i] == h
    assert hashed[0] != hashed[1] and hashed[99] is None
    plain = [str.upper, str.lower, lambda t: t.replace(" ", "  "), lambda t: re.sub("([.,])", r" \1 ", t), lambda t: t.replace(" ", "\t"), lambda t: t.replace(" ", "\u00a0"), lambda t: re.sub(r"(\w)(\w)", "\\1\u200b\\2", t, flags=re.ASCII), str]
    noisy = {r.doc_id: r for r in catalog.queries()["format_noise"](spark, str(tmp_path)).collect()}
    assert len(noisy) == len(texts) + 1 and len({r.mode for r in noisy.values()}) == 8
    for i, t in enumerate(texts):
        assert noisy[i].noisy_sha256 == hashlib.sha256(plain[i % 8](t).encode()).hexdigest(), noisy[i].mode


def test_every_vector_is_scored(spark, sf):
    from mossgraph import catalog

    want = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    for name in ("cosine_scores", "margin"):
        assert {r.vec_id for r in catalog.queries()[name](spark, sf).select("vec_id").collect()} == want


def test_blake_features(spark):
    """Signed hashing by BLAKE2b of two texts, gram by gram."""
    import hashlib

    texts = ["Call 555-123-4567 now,  now", "", None, "é b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in text.hashed(rows, exact=True).collect():
        got.setdefault(r.doc_id, {})[r.slot] = r.value
    for i, t in enumerate(texts):
        clean, want = " ".join((t or "").lower().split()), {}
        for gram in [*clean.split(), *(clean[k : k + n] for n in (3, 4, 5) for k in range(len(clean) - n + 1))]:
            h = int.from_bytes(hashlib.blake2b(f"42:{gram}".encode(), digest_size=8).digest(), "little")
            want[h % 384] = want.get(h % 384, 0.0) + (1.0 if (h // 384) % 2 == 0 else -1.0)
        if i == 0:
            want[4] = want.get(4, 0.0) + 2.5  # "call"
            want[3] = want.get(3, 0.0) + 2.0  # a telephone number
        size = sum(v * v for v in want.values()) ** 0.5
        assert got.get(i, {}) == pytest.approx({s: v / size for s, v in want.items()}) if want else i not in got


def test_labels_over_the_threshold_leave_none_out(spark):
    scores = [(1, 0, "NONE", 0.9), (1, 2, "EMAIL", 0.6), (2, 0, "NONE", 0.9), (2, 2, "EMAIL", 0.4), (3, 0, "NONE", 0.1), (3, 2, "EMAIL", 0.2)]
    got = evaluation.chosen_or_best(spark.createDataFrame(scores, "id int, idx int, label string, score double"), "id").collect()
    assert {r.id: r.labels for r in got} == {1: ["EMAIL"], 2: ["NONE"], 3: ["EMAIL"]}


def test_scores_of_large_readouts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(20)], "id int, u array<double>")
    readout = spark.createDataFrame([(k, rng.normal(size=5).tolist()) for k in "abc"], "label string, centroid array<double>")
    one, other = ({(r.id, r.label): (r.score, r.p) for r in f(rows, readout, "id").collect()} for f in (facts.scored, facts.scored_rows))
    assert len(one) == 60 and all(one[k] == pytest.approx(other[k]) for k in one)
    monkeypatch.setattr(facts, "MOST_NUMBERS", 3)
    with pytest.raises(ValueError):
        facts.scored(rows, readout, "id")
    case = spark.createDataFrame([(1, *[facts.DOMAIN[f][0] for f in facts.FIELDS]), (2, None, "odd", *[facts.DOMAIN[f][0] for f in facts.FIELDS[2:]])], f"case_id int, {', '.join(f + ' string' for f in facts.FIELDS)}")
    for r in facts.encoded(case).join(case, "case_id").collect():
        want = np.zeros(96)
        for f in facts.FIELDS:
            h = 2166136261
            for c in f"{f}:{r[f] or 'unknown'}".lower():
                h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
            want[h % 96] += 1.0 if h >> 9 & 1 else -1.0
            want[(h % 96 + 31) % 96] += 0.38 if h >> 13 & 1 else -0.38
        assert np.allclose(r.u, want / np.linalg.norm(want))


def test_states_of_large_graphs(spark, ring, monkeypatch):
    nodes, edges = ring
    rows = spark.createDataFrame([(k, np.random.default_rng(k).normal(size=5).tolist()) for k in range(4)], "id long, u array<double>")
    ask = lambda: {r.id: (r.energy, r.last) for r in reservoir.states(rows, edges, nodes, 10, 20, 5, 1.15, 4, 0.28, 0.7, "id").collect()}
    small = ask()
    monkeypatch.setattr(reservoir, "BROADCAST_BYTES", 0)
    large = ask()
    assert len(small) == 4 and all(np.allclose(small[k][1], large[k][1], atol=1e-9) and abs(small[k][0] - large[k][0]) < 1e-9 for k in small)


def test_anatomy_files_and_names_by_content(spark, tmp_path):
    bodies = spark.createDataFrame([(1, 20, None, None, None, 1), (0, 10, 5, 6, 7, 9)], "idx long, body_id long, x long, y long, z long, flags int")
    raw, digest = sinks.binary_anatomy(bodies)
    (tmp_path / "a.bin").write_bytes(raw)
    got = [tuple(r) for r in tables.binary_anatomy(spark, str(tmp_path / "a.bin")).orderBy("node").collect()]
    assert got == [(0, 10, 5, 6, 7, 9), (1, 20, None, None, None, 1)] and len(digest) == 64
    with pytest.raises(ValueError, match="missing place"):
        sinks.binary_anatomy(bodies.withColumn("flags", F.lit(8)))
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 0, 0.5), (1, 1, 1.0)], "src long, dst long, w double")
    raw, _ = sinks.binary_graph(edges, 2)
    (tmp_path / "g.bin").write_bytes(raw)
    assert sorted(tuple(r) for r in tables.binary_graph(spark, str(tmp_path / "g.bin")).collect()) == [(0, 1, 2.0), (1, 0, 0.5), (1, 1, 1.0)]
    one, two = (sinks.content_addressed(spark, {"b": 1, "a": [2]}, str(tmp_path / "c")) for _ in range(2))
    assert one == two and spark.read.text(one).first().value == '{"a":[2],"b":1}'


def test_feather_and_experiment_files(spark, tmp_path):
    import json

    import pyarrow as pa
    from pyarrow import feather

    for k in range(2):
        feather.write_feather(pa.table({"body": [k, k + 10], "kind": ["a", None]}), str(tmp_path / f"f{k}.feather"))
        (tmp_path / f"experiment_{k}").mkdir()
        (tmp_path / f"experiment_{k}" / "result.json").write_text(json.dumps({"model_type": "linear", "seed": k, "encoder": "hashing", "metrics_test": {"macro_f1": 0.5 + k}, "other": 1}, indent=1))
    assert sorted(r.body for r in tables.feather(spark, str(tmp_path / "*.feather"), ["body"]).collect()) == [0, 1, 10, 11]
    assert [(r.run, r.seed, r.macro_f1) for r in tables.experiments(spark, str(tmp_path)).collect()] == [("experiment_0", 0, 0.5), ("experiment_1", 1, 1.5)]


def test_guards_of_parameters(spark):
    from mossgraph.operators import validation

    rows = spark.createDataFrame([(12,)], "steps int")
    assert rows.select(validation.step_guard(F.col("steps"))).first()[0] == 12
    with pytest.raises(Exception, match="timesteps must be 12"):
        rows.select(validation.step_guard(F.col("steps") + 1)).collect()
    assert rows.select(validation.graph_bytes(F.lit(0), F.lit(5))).first()[0] is None
    with pytest.raises(Exception, match="several annotations"):
        graph.aligned(spark.range(2).selectExpr("id idx", "id node"), spark.createDataFrame([(1, 2, 3, 4)] * 2, "node long, x int, y int, z int")).collect()
    cases = spark.createDataFrame([(1, "let-rest", "teach")], "case_id int, label string, split string")
    with pytest.raises(Exception, match="unknown action"):
        facts.corrected(cases, spark.createDataFrame([(1, "nope")], "case_id int, label string"), "1").collect()


def test_provenance_and_manifests(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0])], "id long, v array<double>")
    text = F.concat_ws(":", F.col("id").cast("string"), F.concat_ws(",", F.transform("v", lambda x: F.format_string("%.6f", x))))
    good = {"rows": 2, "dimensions": 2, "unit": True, "digest": graph.ordered_digest(rows, ["id"], text).first()["digest"]}
    assert guards.provenance(rows, "id", "v", good).count() == 2
    for bad, why in (({"rows": 3}, "rows or dimensions"), ({"digest": "x"}, "digest")):
        with pytest.raises(ValueError, match=why):
            guards.provenance(rows, "id", "v", good | bad)
    long = rows.withColumn("v", F.transform("v", lambda x: x * 2))
    with pytest.raises(ValueError, match="unit length"):
        guards.provenance(long, "id", "v", good | {"digest": graph.ordered_digest(long, ["id"], text).first()["digest"]})
    many = spark.range(2500).select("id", F.col("id").cast("string").alias("t"))
    one, two = (graph.ordered_digest(df, ["id"], F.col("t"), 100).first()["digest"] for df in (many, many.repartition(7)))
    assert one == two
    (tmp_path / "files").mkdir()
    for name in ("a", "b"):
        (tmp_path / "files" / name).write_text(name)
    assert {r.name: r.status for r in sinks.publish(spark, str(tmp_path / "files"), str(tmp_path / "manifest")).collect()} == {"a": "ok", "b": "ok"}
