"""Cases of eight categorical facts: encoding, rules, centroid readouts and their evaluation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.hashing import fnv1a, fnv1a_of

#: Facts and what each may be.
DOMAIN = {
    "matter": ("damage", "debt", "property", "delivery", "boundary", "insult", "account", "charter", "official", "threat"),
    "property": ("none", "crops", "animal", "tool", "goods", "payment", "money", "land", "document", "public place", "small item", "service", "clothing", "fence"),
    "harm": ("none", "low", "moderate", "high"),
    "proof": ("unclear", "witness", "admitted", "document"),
    "intent": ("unclear", "careless", "deliberate", "unable"),
    "relationship": ("neighbors", "trade", "official"),
    "urgency": ("low", "ordinary", "high"),
    "ability": ("able", "unable"),
}
FIELDS = tuple(DOMAIN)
#: Actions and their names.
ACTIONS = {
    "let-rest": "Let the matter rest.",
    "seek-small-reparation": "Seek small reparation.",
    "seek-full-reparation": "Seek full reparation.",
    "request-return": "Request return of property.",
    "find-witness": "Find a witness.",
    "sworn-account": "Request a sworn account within the fictional charter.",
    "propose-settlement": "Propose settlement.",
    "refer-higher": "Refer the matter to a higher authority.",
}
NO_ACTION = "Abstain."
#: Dimensions, second slot's distance and weight, sign bits; steps, leak and input scale; limits of the readout.
DIM, SHIFT, SECOND, BITS = 96, 31, 0.38, (9, 13)
STEPS, LEAK, INPUT_SCALE, FEATURES = 4, 0.28, 1.15, 256
TEMPERATURE, CONFIDENCE, MARGIN, QUIET = 4.0, 0.28, 0.045, 1e-5
#: Readouts above this many numbers (32 MB) aren't sent to every task.
MOST_NUMBERS = 1 << 22


def stand_in(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """case_id, split, label and the eight facts, derived from orders and their customers."""
    pick = lambda field, i: F.element_at(F.array(*map(F.lit, DOMAIN[field])), (F.pmod(i, F.lit(len(DOMAIN[field]))) + 1).cast("int")).alias(field)
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    facts = rows.select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "holdout").otherwise("teach").alias("split"),
        pick("matter", F.ascii("o_orderpriority") + F.col("c_nationkey")),
        pick("property", F.col("o_custkey")),
        pick("harm", F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(3))),
        pick("proof", F.col("o_orderkey")),
        pick("intent", F.col("c_nationkey")),
        pick("relationship", F.col("o_custkey")),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "3-MEDIUM", "ordinary").otherwise("low").alias("urgency"),
        F.when(F.col("c_acctbal") < 0, "unable").otherwise("able").alias("ability"),
    )
    return facts.withColumn("label", rules())


def rules() -> Column:
    """The decision list: the first rule that holds."""
    c = F.col
    return (
        F.when((c("urgency") == "high") & ((c("harm") == "high") | c("matter").isin("threat", "official")), "refer-higher")
        .when((c("proof") == "unclear") & c("matter").isin("boundary", "insult", "property"), "find-witness")
        .when((c("matter") == "property") & (c("property") != "none"), "request-return")
        .when((c("ability") == "unable") | (c("matter") == "debt"), "propose-settlement")
        .when(c("matter").isin("account", "charter"), "sworn-account")
        .when((c("harm") == "high") | (c("intent") == "deliberate"), "seek-full-reparation")
        .when(c("harm").isin("moderate", "low") | c("matter").isin("damage", "delivery"), "seek-small-reparation")
        .otherwise("let-rest")
    )


def violations(cases: DataFrame) -> DataFrame:
    """case_id, field, value of facts outside their domain."""
    rows = cases.select("case_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x")).select("case_id", "x.field", "x.value")
    inside = None
    for f in FIELDS:
        this = (F.col("field") == f) & F.col("value").isin(*DOMAIN[f])
        inside = this if inside is None else inside | this
    return rows.where(~F.coalesce(inside, F.lit(False)))


def _slots(token: Column) -> Column:
    """A token's two signed weights as a vector of DIM slots."""
    sign = lambda h, bit, size: F.when(F.shiftright(h, bit).bitwiseAND(F.lit(1).cast("long")) == 1, size).otherwise(-size)
    places = F.sequence(F.lit(0), F.lit(DIM - 1))
    return vectors.let(lambda h: F.transform(places, lambda j: F.when(h % DIM == j, sign(h, BITS[0], 1.0)).otherwise(0.0) + F.when((h % DIM + SHIFT) % DIM == j, sign(h, BITS[1], SECOND)).otherwise(0.0)), h=fnv1a(F.lower(token)))


def _known(field: str, value: str) -> list[float]:
    h = fnv1a_of(f"{field}:{value}".lower())
    out = [0.0] * DIM
    for slot, bit, size in ((h % DIM, BITS[0], 1.0), ((h % DIM + SHIFT) % DIM, BITS[1], SECOND)):
        out[slot] += size if h >> bit & 1 else -size
    return out


def encoded(cases: DataFrame) -> DataFrame:
    """case_id and ``u``, the unit vector of hashed facts.

    The domain's values are hashed once, on the driver, and looked up; only values outside it are hashed row by row. No shuffle.
    """
    parts = []
    for f in FIELDS:
        value = F.coalesce(f, F.lit("unknown"))
        known = F.from_json(F.lit(json.dumps({v: _known(f, v) for v in (*DOMAIN[f], "unknown")})), "map<string,array<double>>")  # a constant
        parts.append(F.coalesce(F.try_element_at(known, value), _slots(F.concat(F.lit(f"{f}:"), value))))
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda x, y: x + y)
    return cases.select("case_id", vectors.unit(total).alias("u"))


def centroids(vectors_: DataFrame, label: str = "label", vector: str = "u", times: str | None = None) -> DataFrame:
    """label and centroid: the mean vector of each label, summed in each task first. ``times``: how many examples have the vector."""
    v = F.col("v").cast("double")
    mean = F.avg(v) if times is None else F.sum(v * F.col(times)) / F.sum(times)
    flat = vectors_.select(label, *([times] if times else []), F.posexplode(vector).alias("pos", "v")).groupBy(label, "pos").agg(mean.alias("v"))
    packed = flat.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("c"))  # one entry a dimension
    return packed.select(label, F.transform("c", lambda x: x["v"]).alias("centroid"))


def scored_arrays(examples: DataFrame, readout: DataFrame, key: str, vector: str = "u", temperature: float = TEMPERATURE) -> DataFrame:
    """key and scores: an array of label, score (cosine) and p (softmax) for each label, in the labels' order. One row holds all centroids; a readout above ``MOST_NUMBERS`` numbers is refused."""
    size = readout.agg(F.sum(F.size("centroid"))).first()[0] or 0
    if size > MOST_NUMBERS:
        raise ValueError("the readout is too large to go to every task; use scored_rows")
    packed = readout.agg(F.array_sort(F.collect_list(F.struct("label", "centroid", vectors.dot(F.col("centroid"), F.col("centroid")).alias("qq")))).alias("q"))
    rows = examples.select(key, F.col(vector).alias("v"), vectors.dot(F.col(vector), F.col(vector)).alias("uu")).join(F.broadcast(packed))
    cosines = rows.select(key, F.transform("q", lambda q: F.struct(q["label"].alias("label"), (vectors.dot(F.col("v"), q["centroid"]) / F.greatest(F.lit(1e-12), F.sqrt(q["qq"] * F.col("uu")))).alias("score"))).alias("s"))
    p = cosines.withColumn("p", vectors.softmax(F.transform("s", lambda x: x["score"]), temperature))
    return p.select(key, F.zip_with("s", "p", lambda s, p: F.struct(s["label"].alias("label"), s["score"].alias("score"), p.alias("p"))).alias("scores"))


def scored(examples: DataFrame, readout: DataFrame, key: str, vector: str = "u", temperature: float = TEMPERATURE) -> DataFrame:
    """key, label, score (cosine), p (softmax): every example against every centroid, without a shuffle of examples."""
    return scored_arrays(examples, readout, key, vector, temperature).select(key, F.explode("scores").alias("x")).select(key, "x.label", "x.score", "x.p")


def scored_rows(examples: DataFrame, readout: DataFrame, key: str, vector: str = "u", temperature: float = TEMPERATURE) -> DataFrame:
    """The same for readouts of any size: products are joined by position and summed. Keys must be unique."""
    flat = lambda df, name, v: df.select(name, F.posexplode(v).alias("pos", "x"))
    dots = flat(examples, key, vector).join(flat(readout, "label", "centroid").withColumnRenamed("x", "y"), "pos").groupBy(key, "label").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    sizes = dots.join(examples.select(key, vectors.dot(F.col(vector), F.col(vector)).alias("uu")), key).join(readout.select("label", vectors.dot(F.col("centroid"), F.col("centroid")).alias("qq")), "label")
    rows = sizes.select(key, "label", (F.col("dot") / F.greatest(F.lit(1e-12), F.sqrt(F.col("uu") * F.col("qq")))).alias("score"))
    best = rows.groupBy(key).agg(F.max("score").alias("top"))
    e = rows.join(best, key).withColumn("e", F.exp(temperature * (F.col("score") - F.col("top"))))
    return e.join(e.groupBy(key).agg(F.sum("e").alias("total")), key).select(key, "label", "score", (F.col("e") / F.col("total")).alias("p"))


def advised(scores: DataFrame, key: str, energies: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """As ``recommended``, of ``scored_arrays``: nothing is shuffled. ``digits``: likelihoods are rounded before they are compared."""
    p = lambda x: x["p"] if digits is None else F.round(x["p"], digits)
    order = F.array_sort(F.transform("scores", lambda x: F.struct((-p(x)).alias("p"), x["label"].alias("label"))))
    return _decided(scores.select(key, F.slice(order, 1, 2).alias("r")), key, energies)


def recommended(scores: DataFrame, key: str, energies: DataFrame | None = None) -> DataFrame:
    """key, action, forced_choice, confidence, margin, reason: the most likely action, or abstention where it is unclear or the state silent. Ties go to the earlier action."""
    order = F.struct((-F.col("p")).alias("p"), "label")
    return _decided(scores.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(order)), 1, 2).alias("r")), key, energies)  # one entry a label


def _decided(two: DataFrame, key: str, energies: DataFrame | None) -> DataFrame:
    rows = two.select(key, F.element_at("r", 1)["label"].alias("forced_choice"), (-F.element_at("r", 1)["p"]).alias("confidence"), (F.coalesce(F.try_element_at("r", F.lit(2))["p"], F.lit(0.0)) - F.element_at("r", 1)["p"]).alias("margin"))
    rows = rows.join(energies, key, "left") if energies is not None else rows.withColumn("energy", F.lit(1.0))
    quiet = F.coalesce("energy", F.lit(0.0)) < QUIET
    unclear = (F.col("confidence") < CONFIDENCE) | (F.col("margin") < MARGIN)
    return rows.select(key, F.when(quiet | unclear, "abstain").otherwise(F.col("forced_choice")).alias("action"), F.when(~quiet, F.col("forced_choice")).alias("forced_choice"), F.when(quiet, 0.0).otherwise(F.col("confidence")).alias("confidence"), F.when(quiet, 0.0).otherwise(F.col("margin")).alias("margin"), F.when(quiet, "silent").when(unclear, "ambiguous").otherwise("readout").alias("reason"))


def accuracy(advice: DataFrame, truth: DataFrame, key: str = "case_id") -> DataFrame:
    """One row: cases, correct, abstentions, forced-choice correct."""
    rows = advice.join(truth.select(key, "label"), key)
    return rows.agg(F.count("*").alias("cases"), F.count_if(F.col("action") == F.col("label")).alias("correct"), F.count_if(F.col("action") == "abstain").alias("abstained"), F.count_if(F.col("forced_choice") == F.col("label")).alias("forced_correct"))


def action_name(action: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair]), action), F.lit(NO_ACTION))


#: The two authored notes of each action; {} is the property, or "the matter".
NOTES = {
    "let-rest": ("Let the matter rest unless the facts change.", "No further step is advised on the present account."),
    "seek-small-reparation": ("First speak with the other party. Record the harm to {}. Seek modest reparation if it continues.", "Document the harm to {}, then ask for a small reparation."),
    "seek-full-reparation": ("Preserve the account of harm to {}. Seek full reparation under the fictional charter.", "Record the loss involving {} and request full reparation."),
    "request-return": ("Ask for the return of {}. Record the request and any reply.", "Request that {} be returned before taking a further step."),
    "find-witness": ("Find a witness before pressing the petition further.", "Write down the disputed account and seek someone who observed it."),
    "sworn-account": ("Request a sworn account under the fictional village charter.", "Ask each party for a sworn account within the fictional charter."),
    "propose-settlement": ("Put a practical settlement to both parties and record what each accepts.", "Propose terms both parties can keep, then write them into the ledger."),
    "refer-higher": ("Refer the petition to a higher authority. The fly offers no final judgment.", "Place the matter before a higher authority under the fictional charter."),
    "abstain": ("The fly declines to advise on the present facts.", "The account is too uncertain for this fly to recommend a next step."),
}


def notes(action: Column, subject: Column) -> Column:
    """The authored notes of an action (none for others)."""
    about = F.when(subject != "none", subject).otherwise("the matter")
    out = F
    for a, pair in NOTES.items():
        out = out.when(action == a, F.array(*[F.replace(F.lit(n), F.lit("{}"), about) for n in pair]))
    return out.otherwise(F.array().cast("array<string>"))


def field_centroids(examples: DataFrame, truth: DataFrame, key: str = "case_id") -> DataFrame:
    """field, value, centroid (unit length) of the eight facts and the action: the mean vector of each value's examples (key, u)."""
    names = [*FIELDS, "label"]
    values = truth.select(key, F.explode(F.array(*[F.struct(F.lit(n if n != "label" else "action").alias("field"), F.col(n).alias("value")) for n in names])).alias("f")).select(key, "f.*")
    named = examples.join(values, key).select(F.struct("field", "value").alias("label"), "u")
    return centroids(named).select("label.field", "label.value", vectors.unit(F.col("centroid")).alias("centroid"))


def field_decode(examples: DataFrame, fitted: DataFrame, key: str = "case_id", digits: int = 9) -> DataFrame:
    """key, field, value, margin: for every example (key, u) and field the value whose centroid (of ``fitted``: field, value, centroid) it is nearest to, and by how much it beats the next one.

    All centroids are one matrix, sorted by field and value, whose fields are segments of its rows: one product for each batch,
    then greatest and second greatest of each segment. Scores are rounded to ``digits``; ties go to the first value. A field of one
    value has no margin. The values of all fields together have ``MOST_NUMBERS`` numbers at most, else an error.
    """
    rows = sorted(map(tuple, fitted.select("field", "value", "centroid").limit(MOST_NUMBERS // DIM + 1).collect()), key=lambda r: (r[0], r[1] is not None, r[1]))
    if len(rows) * DIM > MOST_NUMBERS:
        raise ValueError("too many values for one matrix")
    fields = [r[0] for r in rows]
    starts = [i for i, f in enumerate(fields) if i == 0 or f != fields[i - 1]]
    shared = examples.sparkSession.sparkContext.broadcast((np.array([r[2] for r in rows]).reshape(len(rows), DIM), [r[1] for r in rows]))
    kind = examples.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, values = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n or not starts:
                continue
            scores = np.round(np.array(batch.column(1).to_pylist(), float).reshape(n, -1) @ matrix.T, digits)
            for a, b in zip(starts, [*starts[1:], len(fields)], strict=True):
                part = scores[:, a:b]
                best = part.argmax(1)
                top = part[np.arange(n), best]
                rest = part.copy()
                rest[np.arange(n), best] = -np.inf
                margin = pa.array(top - rest.max(1), mask=np.full(n, b - a == 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fields[a]] * n), pa.array([values[a + k] for k in best], pa.string()), margin], [key, "field", "value", "margin"])

    return examples.select(key, "u").mapInArrow(run, f"{key} {kind}, field string, value string, margin double")


def parsed(decoded: DataFrame, key: str = "case_id") -> DataFrame:
    """key and the eight facts of what ``field_decode`` has read."""
    read = F.map_from_entries(F.collect_list(F.struct("field", "value")))  # nine entries
    return decoded.groupBy(key).agg(read.alias("m")).select(key, *(F.try_element_at("m", F.lit(f)).alias(f) for f in FIELDS))


def observed(cases: DataFrame) -> DataFrame:
    """field, domain: the sorted values that each fact has among the cases."""
    long = cases.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in FIELDS])).alias("f"))
    return long.groupBy("f.field").agg(F.sort_array(F.collect_set("f.value")).alias("domain"))  # the values of one fact


def parse_accuracy(parsed: DataFrame, truth: DataFrame, key: str = "case_id") -> DataFrame:
    """One row: cases, fields, correct fields, exact parses, of parsed facts against the true ones."""
    right = [F.col(f"p.{f}").eqNullSafe(F.col(f"t.{f}")).cast("int") for f in FIELDS]
    rows = truth.alias("t").join(parsed.alias("p"), F.col(f"t.{key}") == F.col(f"p.{key}")).select(sum(right[1:], right[0]).alias("n"))
    return rows.agg(F.count("*").alias("cases"), (F.count("*") * len(FIELDS)).alias("fields"), F.sum("n").alias("correct"), F.count_if(F.col("n") == len(FIELDS)).alias("exact"))


def corrected(cases: DataFrame, corrections: DataFrame, stamp: str) -> DataFrame:
    """Cases with the corrected ones appended as teaching cases: corrections are (case_id, label). The old ones stay; an unknown label is an error."""
    label = F.when(F.col("label").isin(*ACTIONS), F.col("label")).otherwise(F.raise_error(F.lit("unknown action")).cast("string"))
    fixes = corrections.select("case_id", label.alias("__label"))
    added = cases.join(fixes, "case_id").withColumns({"label": F.col("__label"), "split": F.lit("teach"), "case_id": F.concat(F.col("case_id").cast("string"), F.lit(f"-correction-{stamp}"))}).drop("__label")
    return cases.withColumn("case_id", F.col("case_id").cast("string")).unionByName(added)


def benchmark(cases: DataFrame, key: str = "case_id", **advices: DataFrame) -> DataFrame:
    """key, expected and a column for each predictor (key, action), side by side; a predictor without an answer has null."""
    rows = cases.select(key, F.col("label").alias("expected"))
    for name, advice in advices.items():
        rows = rows.join(advice.select(key, F.col("action").alias(name)), key, "left")
    return rows


def benchmark_accuracy(rows: DataFrame, *names: str) -> DataFrame:
    """name, cases, answered, correct of each predictor's column."""
    long = rows.select("expected", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("action")) for n in names])).alias("x")).select("expected", "x.*")
    return long.groupBy("name").agg(F.count("*").alias("cases"), F.count("action").alias("answered"), F.count_if(F.col("action") == F.col("expected")).alias("correct"))


#: What is said with an action, and without one.
SAID = "The fly can point to the supplied facts and the village charter label, but it cannot explain the path through the wiring."
UNSAID = "The fly declines to advise. The petition is outside what it has been taught, too quiet, or too evenly balanced."


def advice_text(action: Column) -> Column:
    return F.when(action == "abstain", UNSAID).otherwise(F.concat_ws(" ", action_name(action), F.lit(SAID)))
