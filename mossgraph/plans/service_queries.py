"""Learned and looping queries: replay, lesions of a classifier, several models side by side. SQL can't state them; tests check them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import blocks, candidates, controls, evaluation, facts, models, replay, reservoir, sessions
from ..registry import query, table
from ..streaming import serial
from .graph_queries import edges, nodes
from .model_queries import _SCORED, _TRIALS, _trials, cases


def _network(spark, sf_dir, wide=False):
    """The replay network: broadcast, or in blocks if it is large (or ``wide``)."""
    e, n = reservoir.checkpointed(edges(spark, sf_dir)), nodes(spark, sf_dir)
    made = None if wide else reservoir.compressed(e, n)
    if made is None:
        inputs = max(1, n.select("node").distinct().count() // 8)
        return replay.Wide(blocks.built(e, n, inputs, replay.FEATURES, replay.DIM, replay.INPUT_SCALE), 0.01)
    g, names = made
    inputs, outputs = reservoir.picked_roles(names, 42, max(1, len(names) // 8), replay.FEATURES)
    return replay.Network(g, reservoir.sparse_weights(inputs, replay.DIM, replay.INPUT_SCALE), outputs, 0.01)


def _taught(spark, sf_dir, wide=False):
    net = _network(spark, sf_dir, wide)
    inputs = reservoir.checkpointed(replay.drives(table(spark, sf_dir, "benchmark")))
    states = reservoir.checkpointed(replay.read(inputs, net))
    return net, inputs, states, replay.fit(states)


def _session(spark, sf_dir, steps, wide=False):
    net, inputs, states, w = _taught(spark, sf_dir, wide)
    atlas = controls.numbered(states.select("item_id", "features"), ["item_id"]).select((F.col("rn") - 1).alias("pos"), "features")
    return replay.replayed(inputs, net, w, atlas, steps).select("item_id", "step", F.round("rms", 6).alias("rms"), "status", "match")


@query()
def replay_training(spark, sf_dir):
    _, _, states, w = _taught(spark, sf_dir)
    return replay.reconstruction(states, w).select(F.round("error", 6).alias("error"), F.round("without", 6).alias("without"), "states")


@query()
def replay_session(spark, sf_dir):
    """64 closed-loop steps from every card."""
    return _session(spark, sf_dir, 64)


@query()
def replay_session_blocks(spark, sf_dir):
    """Four closed-loop steps from every card, by the graph in blocks."""
    return _session(spark, sf_dir, 4, wide=True)


def _heard(u, e, n, wide=False):
    """Energy and output states, as ``u``, of every kind of case after the fact-driven steps. Energies above ``facts.QUIET`` may be bounds below them."""
    inputs = max(64, n.count() // 180)
    if wide:
        net = blocks.built(e, n, inputs, facts.FEATURES, facts.DIM, facts.INPUT_SCALE)
        return reservoir.checkpointed(blocks.batch_states(u, net, facts.STEPS, facts.LEAK, 0.01, key="kind").drop("mean")).select("kind", "energy", F.col("last").alias("u"))
    return reservoir.states(u, e, n, inputs, facts.FEATURES, facts.DIM, facts.INPUT_SCALE, facts.STEPS, facts.LEAK, 0.01, "kind", least=facts.QUIET).select("kind", "energy", F.col("last").alias("u"))


def _kinds(spark, sf_dir):
    """Cases with their kind, which is their facts; every kind once, encoded; and how many cases teach it under which label. Cases of one kind have one state, so that is made once."""
    c = cases(spark, sf_dir).where("case_id IS NOT NULL").withColumn("kind", F.to_json(F.struct(*facts.FIELDS)))
    u = reservoir.checkpointed(facts.encoded(c.select(F.col("kind").alias("case_id"), *facts.FIELDS).distinct()).withColumnRenamed("case_id", "kind"))
    return c, u, reservoir.checkpointed(c.where("split = 'teach'").groupBy("kind", "label").agg(F.count("*").alias("times")))


def _advice(spark, sf_dir, wide=False):
    c, u, teach = _kinds(spark, sf_dir)
    got = _heard(u, reservoir.checkpointed(edges(spark, sf_dir)), nodes(spark, sf_dir), wide)
    readout = facts.centroids(got.join(teach, "kind"), times="times")
    held = c.where("split = 'holdout'").select("case_id", "kind")
    scores = facts.scored_arrays(got.join(held.select("kind"), "kind", "left_semi"), readout, "kind")
    advice = facts.advised(scores, "kind", got.select("kind", "energy"))
    return held.join(advice, "kind").select("case_id", "action", "forced_choice", F.round("confidence", 6).alias("confidence"), "reason")


@query()
def village_hear(spark, sf_dir):
    """Four steps of the fact-driven reservoir for every case, read out by the centroids of the teaching cases."""
    return _advice(spark, sf_dir)


@query()
def village_hear_blocks(spark, sf_dir):
    """The same by the graph in blocks."""
    return _advice(spark, sf_dir, wide=True)


@query()
def lesion_study(spark, sf_dir):
    """Accuracy of a frozen centroid readout of the reservoir's activity, intact and after each lesion."""
    c, u, teach = _kinds(spark, sf_dir)
    e, n = reservoir.checkpointed(edges(spark, sf_dir)), nodes(spark, sf_dir)
    truth = c.where("split = 'holdout'").select("kind", "label")
    out, readout = None, None
    for kind, fraction in (("intact", 0.0), ("remove_fraction", 0.05), ("remove_fraction", 0.25), ("remove_high_degree", 0.05), ("remove_low_degree", 0.05)):
        kept = e if kind == "intact" else controls.cut(e, controls.lesion_nodes(kind, e, n, fraction))
        states = _heard(u, kept if kind == "intact" else reservoir.checkpointed(kept), n)
        if readout is None:
            readout = reservoir.checkpointed(facts.centroids(states.join(teach, "kind"), times="times"))
        held = states.join(truth.select("kind"), "kind", "left_semi")
        row = facts.accuracy(facts.advised(facts.scored_arrays(held, readout, "kind"), "kind"), truth, "kind").withColumn("lesion", F.lit(f"{kind} {fraction:g}"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"{_SCORED} SELECT c.case_id, label AS rules, forced_choice AS facts, action, label IS NOT DISTINCT FROM forced_choice AS agree FROM c LEFT JOIN adv USING (case_id) WHERE split = 'holdout'")
def twin_classification(spark, sf_dir):
    """Each held-out case by rules and by facts alone, with whether they agree."""
    c = cases(spark, sf_dir)
    u = reservoir.checkpointed(facts.encoded(c).join(c.select("case_id", "label", "split"), "case_id"))
    advice = facts.advised(facts.scored_arrays(u.where("split = 'holdout'").select("case_id", "u"), facts.centroids(u.where("split = 'teach'")), "case_id"), "case_id", digits=12)
    return c.where("split = 'holdout'").select("case_id", F.col("label").alias("rules")).join(advice.select("case_id", F.col("forced_choice").alias("facts"), "action"), "case_id", "left").withColumn("agree", F.col("rules").eqNullSafe(F.col("facts")))


PENALTIES = (0.01, 0.1, 1.0)


@query()
def readout_search(spark, sf_dir):
    """Penalties of the logistic readout, all fitted in the same passes and compared on a validation part; the first best is frozen and scored on the test part."""
    part = F.when(F.col("vec_id") % 4 < 2, "train").when(F.col("vec_id") % 4 == 2, "validation").otherwise("test")
    rows = reservoir.checkpointed(table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.lit("vectors").alias("features"), "vec_id", F.col("embedding").alias("x"), F.array((F.col("label") % 2).cast("int")).alias("y"), part.alias("split")))
    race = [candidates.Candidate(str(c), "vectors", c) for c in PENALTIES]
    readouts = candidates.fitted(rows.where("split = 'train'"), race, 1)
    p = candidates.probabilities(rows.where("split <> 'train'"), race, readouts, "vec_id").join(rows.select("vec_id", "y", "split"), "vec_id")
    right = ((F.col("p")[0] >= 0.5).cast("int") == F.col("y")[0]).cast("double")
    wide = p.groupBy("candidate").agg(F.avg(F.when(F.col("split") == "validation", right)).alias("validation"), F.avg(F.when(F.col("split") == "test", right)).alias("test"))
    return wide.withColumn("c", F.col("candidate").cast("double")).orderBy(F.desc("validation"), "c").limit(1).select("c", F.round("validation", 4).alias("validation"), F.round("test", 4).alias("test"))


def _classified(spark, sf_dir):
    """Documents with what they hold, as rows of a text classifier: id, text, labels, split."""
    has = lambda pattern, name: F.when(F.col("text").rlike(pattern), name)
    labels = F.filter(F.array(has(r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", "EMAIL"), has(r"(?i)(password|secret|token|api_?key)", "CREDENTIAL"), has(r"\b\d{3}-\d{2}-\d{4}\b", "SSN"), has(r"\+?\d[\d ()-]{8,}\d", "PHONE")), lambda x: x.isNotNull())
    split = F.when(F.col("doc_id") % 5 < 3, "train").when(F.col("doc_id") % 5 == 3, "validation").otherwise("test")
    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return reservoir.checkpointed(rows.select(F.col("doc_id").alias("id"), "text", F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("NONE"))).alias("labels"), split.alias("split")))


#: A bundle's settings in the queries: fewer steps and outputs than the models' default, over all nodes of the graph.
BUNDLE = {"timesteps": 4, "outputs": 48, "input_dim": 16, "readout_steps": 12}


@query()
def model_comparison(spark, sf_dir):
    """Every kind of logistic model under two seeds on all documents, side by side."""
    got = models.comparison(["linear", "connectome", "random_weights"], [42, 43], _classified(spark, sf_dir), reservoir.checkpointed(edges(spark, sf_dir)), nodes(spark, sf_dir), **BUNDLE)
    return got.select("model", "seed", "split", "examples", *(F.round(c, 4).alias(c) for c in ("exact_match", "macro_f1", "micro_f1", "binary_accuracy")))


@query()
def lesions_retrained(spark, sf_dir):
    """The connectome model after lesions, its readouts fitted anew."""
    specs = [("remove_fraction", 0.25, None), ("remove_high_degree", 0.05, None)]
    got = models.lesions(_classified(spark, sf_dir), reservoir.checkpointed(edges(spark, sf_dir)), nodes(spark, sf_dir), specs, **BUNDLE)
    return got.select("lesion", *(F.round(c, 4).alias(c) for c in ("macro_f1", "delta_macro_f1", "original_macro_f1")))


@query()
def profile_search(spark, sf_dir):
    """Profiles of the connectome model (leak and feature mode) with two penalties each, chosen on the validation part alone; the worse half leaves after six passes."""
    data = _classified(spark, sf_dir).where("split <> 'test'")
    e, n = reservoir.checkpointed(edges(spark, sf_dir)), nodes(spark, sf_dir)
    bundles = {f"leak {leak} {mode}": models.built("connectome", e, n, leak=leak, feature_mode=mode, **BUNDLE) for leak in (0.3, 0.6) for mode in ("states", "hybrid")}
    race = [candidates.Candidate(f"{name} c {c}", name, c) for name in bundles for c in (0.1, 1.0)]
    best, got = models.searched(race, models.featured(bundles, data), rungs=(6,), steps=BUNDLE["readout_steps"])
    return got.select("candidate", F.round("macro_f1", 4).alias("macro_f1"), (F.col("candidate") == (best.name if best else "")).alias("chosen"))


@query(f"WITH {_TRIALS} SELECT model, printf('%.4f +- %.4f', avg(macro_f1), stddev_pop(macro_f1)) AS macro_f1 FROM t GROUP BY model")
def summary_report(spark, sf_dir):
    from ..sources.sinks import summary_table

    return summary_table(evaluation.model_summary(_trials(spark, sf_dir)))


# Events as commands to the user's session, with two minutes between frames.
_KINDS = {"signup": "train", "view": "start", "click": "resume", "error": "pause", "purchase": "export"}
_TICK = 120_000_000
_SESSIONS = f"""WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS command FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
m AS (SELECT *, coalesce(max(command = 'train') OVER w, false) AS model, lead(CASE WHEN command <> 'export' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, command IN ('start', 'resume') AND model AS runs, count(*) FILTER (command = 'train' OR (command = 'start' AND model)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM m),
f AS (SELECT *, CASE WHEN NOT runs THEN 0 WHEN next IS NULL THEN 256 ELSE least(256, (next - t + {_TICK - 1}) // {_TICK}) END AS wanted, last_value(CASE WHEN command <> 'export' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id, epoch ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_at,
    last_value(CASE WHEN command <> 'export' THEN runs END IGNORE NULLS) OVER (PARTITION BY user_id, epoch ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ran FROM r),
g AS (SELECT *, coalesce(sum(wanted) OVER v, 0) AS before, coalesce(last_value(CASE WHEN command <> 'export' THEN wanted END IGNORE NULLS) OVER v, 0) AS own FROM f WINDOW v AS (PARTITION BY user_id, epoch ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, least(256, CASE WHEN command <> 'export' THEN before ELSE least(256, before - own) + CASE WHEN ran THEN (t - last_at + {_TICK - 1}) // {_TICK} ELSE 0 END END) AS started FROM g)
SELECT user_id, event_id, command, CASE WHEN model THEN NULL WHEN command = 'start' THEN 'Read a corpus first' WHEN command = 'export' THEN 'No session to export' WHEN command = 'resume' THEN 'No paused session' END AS problem,
    (8 * started)::BIGINT AS first_step, least(wanted, 256 - started)::BIGINT AS frames, (8 * (started + least(wanted, 256 - started)))::BIGINT AS last_step,
    CASE WHEN runs THEN CASE WHEN next IS NULL OR next >= t + (256 - started) * {_TICK} THEN 'complete' ELSE 'superseded' END WHEN NOT model THEN 'ready' WHEN command = 'export' THEN 'downloaded' ELSE 'paused' END AS status FROM h"""


def _commands(rows):
    kind = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))
    return rows.select("user_id", "event_id", "ts", F.try_element_at(kind, F.col("event_type")).alias("command"))


@query(_SESSIONS)
def replay_commands(spark, sf_dir):
    """Every event as a command to its user's session."""
    return sessions.answered(_commands(table(spark, sf_dir, "events")), "user_id", "ts", "event_id", "command", _TICK)


@query(_SESSIONS)
def replay_commands_stream(spark, sf_dir):
    """The same by a stream with a serial state. A row long after all others, without an id, lets the watermark pass them."""
    events = table(spark, sf_dir, "events")
    reservoir.checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/mossgraph-{uuid.uuid4().hex}"
    events.agg((F.coalesce(F.max("ts"), F.to_timestamp(F.lit("1970-01-02"))) + F.expr("INTERVAL 30 DAYS")).cast(events.schema["ts"].dataType).alias("ts")).select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema)).write.parquet(f"{at}/end")
    read = lambda path: spark.readStream.schema(events.schema).parquet(path)  # noqa: E731 (a stream takes a pattern or a folder, not the name of one file)
    rows = read(f"{sf_dir.rstrip('/')}/events.parque[t]").unionAll(read(f"{at}/end"))
    out = serial.folded(_commands(rows), serial.Sessions(_TICK), "user_id", "ts", "event_id", "command")
    serial.started(out, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")
