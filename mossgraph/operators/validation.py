"""Checks of cases, models, drafts, commands and fixtures: rows with what is wrong with them, and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a
from . import facts

#: Longest texts of a case's fields, what stands for missing ones, steps that a simulation has.
LONGEST = {"id": 100, "family": 100, "title": 160, "villager": 120, "prop": 80, "petition": 1000}
INSTEAD = {"family": "custom", "title": "Custom petition", "villager": "A villager", "prop": "petition", "petition": "A petition was brought to the desk."}
FACT_LENGTH, STEPS, MOST_SEED = 80, 12, 0xFFFFFFFF
#: Commands of a worker, with their fields and the greatest length of each.
COMMANDS = {"enable": {}, "cancel": {}, "dispose": {}, "encode": {"petition": 1000}, "verbalize": {"facts": 2000, "action": 80, "confidenceBand": 6}, "benchmark": {"cases": 200_000}}
BANDS = ("low", "medium", "high")


def problems(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, problem of every row and check that doesn't hold (null counts as not)."""
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(found).alias("problem"))


def text_fits(c: Column, most: int) -> Column:
    return (F.length(F.trim(c)) > 0) & (F.length(c) <= most)


def normal_cases(cases: DataFrame) -> DataFrame:
    """Cases with trimmed fields, what stands for missing ones, a split, and an id from the facts where there is none."""
    facts_json = F.to_json(F.struct(*[F.trim(F.col(f)).alias(f) for f in facts.FIELDS]))
    own = F.concat(F.lit("custom-"), fnv1a(facts_json).cast("string"))
    rest = [F.trim(F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit(v))).alias(f) for f, v in INSTEAD.items()]
    split = F.when(F.col("split") == "holdout", "holdout").otherwise("teach").alias("split")
    return cases.select(F.trim(F.coalesce(F.nullif(F.col("id"), F.lit("")), own)).alias("id"), split, *rest, *[F.trim(F.col(f)).alias(f) for f in facts.FIELDS], F.trim("label").alias("label"))


def case_problems(cases: DataFrame) -> DataFrame:
    """id, problem: facts missing or too long, texts too long, an unknown label."""
    checks = {f"facts.{f}": text_fits(F.col(f), FACT_LENGTH) for f in facts.FIELDS}
    checks |= {f: F.coalesce(F.length(f) <= n, F.lit(True)) for f, n in LONGEST.items()}
    checks["label"] = F.col("label").isNull() | F.trim("label").isin(*facts.ACTIONS)
    return problems(cases, "id", checks)


def command_problems(commands: DataFrame) -> DataFrame:
    """id, problem of commands (id, type, fields: map of texts): the type, exactly its fields, their lengths, and for counsel a known action and confidence band."""
    out = {"type": F.col("type").isin(*COMMANDS)}
    keys = F.sort_array(F.map_keys(F.coalesce("fields", F.create_map().cast("map<string,string>"))))
    exact = F.lit(False)
    fits = F.lit(True)
    for name, fields in COMMANDS.items():
        wanted = F.array(*map(F.lit, sorted(fields))).cast("array<string>")
        exact = exact | ((F.col("type") == name) & (keys == wanted))
        for f, most in fields.items():
            fits = fits & ((F.col("type") != name) | text_fits(F.try_element_at("fields", F.lit(f)), most))
    of = lambda f: F.try_element_at("fields", F.lit(f))
    known = (F.col("type") != "verbalize") | (of("action").isin(*facts.ACTIONS) & of("confidenceBand").isin(*BANDS))
    return problems(commands, "id", out | {"fields": exact, "length": fits, "values": known})


def model_problems(models: DataFrame, schema: str, fingerprint: str, outputs: int) -> DataFrame:
    """id, problem of models (id, schema, fingerprint, seed, labels, centroids): of another engine or graph, seeds out of range, other actions, wrong shapes, weights that aren't finite or above 10."""
    numbers = F.forall("centroids", lambda row: (F.size(row) == outputs) & F.forall(row, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 10)))
    checks = {
        "schema": F.col("schema") == schema,
        "fingerprint": F.col("fingerprint") == fingerprint,
        "seed": F.col("seed").between(0, MOST_SEED),
        "actions": F.col("labels") == F.array(*map(F.lit, facts.ACTIONS)),
        "weights": (F.size("centroids") == len(facts.ACTIONS)) & numbers,
    }
    return problems(models, "id", checks)


def replay_problems(models: DataFrame, schema: str, fingerprint: str, rows: int, columns: int) -> DataFrame:
    """id, problem of replay models (id, schema, fingerprint, seed, weights, error, without): as ``model_problems``, and a map that is worse than none."""
    checks = {
        "schema": F.col("schema") == schema,
        "fingerprint": F.col("fingerprint") == fingerprint,
        "seed": F.col("seed").between(0, MOST_SEED),
        "weights": (F.size("weights") == rows) & F.forall("weights", lambda r: (F.size(r) == columns) & F.forall(r, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))),
        "diagnostics": (F.col("error") >= 0) & (F.col("error") <= F.col("without")),
    }
    return problems(models, "id", checks)


def draft_problems(drafts: DataFrame) -> DataFrame:
    """id, problem of drafts (id, facts, confidence, local): facts outside the domain, confidence outside 0 to 1, a receipt that isn't local."""
    checks = {f"facts.{f}": F.col(f).isin(*facts.DOMAIN[f]) for f in facts.FIELDS}
    return problems(drafts, "id", checks | {"confidence": F.col("confidence").between(0.0, 1.0), "receipt": F.col("local")})


def note_problems(notes: DataFrame) -> DataFrame:
    """id, problem of selected notes (id, action, expected, property, text): another action, or a text that isn't authored for it."""
    checks = {"action": F.col("action") == F.col("expected"), "text": F.array_contains(facts.notes(F.col("expected"), F.col("property")), F.col("text"))}
    return problems(notes, "id", checks)


def benchmark_problems(rows: DataFrame) -> DataFrame:
    """id, problem of benchmark rows (id, expected, actual, confidence): unknown actions, confidence that isn't finite or outside 0 to 1."""
    known = [*facts.ACTIONS, "abstain"]
    ok = ~F.isnan("confidence") & F.col("confidence").between(0.0, 1.0)
    return problems(rows, "id", {"expected": F.col("expected").isin(*facts.ACTIONS), "actual": F.col("actual").isin(*known), "confidence": ok})


def expectation_problems(expected: DataFrame, actual: DataFrame, floor: float = 0.01) -> DataFrame:
    """id, problem of expected decisions (id, label, runner_up, margin) against actual ones (id, label): missing, stray or twice; margins that aren't finite or below 0; a runner-up like the label; and another decision, unless the margin is below ``floor``."""
    e = expected.groupBy("id").agg(F.count("*").alias("times"), F.first("label").alias("label"), F.first("runner_up").alias("runner_up"), F.first("margin").alias("margin"))
    both = e.join(actual.select("id", F.col("label").alias("is"), F.lit(True).alias("there")), "id", "full")
    has = F.col("times").isNotNull()
    checks = {
        "stray": has,
        "missing": F.col("there").isNotNull(),
        "twice": ~has | (F.col("times") == 1),
        "margin": ~has | (~F.isnan("margin") & (F.col("margin") >= 0)),
        "runner_up": ~has | (F.col("label") != F.col("runner_up")),
        "decision": ~has | F.col("there").isNull() | (F.col("label") == F.col("is")) | ((F.col("margin") < floor) & (F.col("runner_up") == F.col("is"))),
    }
    return problems(both, "id", checks)


def step_guard(steps: Column) -> Column:
    """The steps, or an error where they aren't those that the model was trained with."""
    return F.when(steps == STEPS, steps).otherwise(F.raise_error(F.concat(F.lit("timesteps must be "), F.lit(STEPS).cast("string"))).cast("int"))


def graph_bytes(nodes: Column, edges: Column) -> Column:
    """Bytes of a binary graph file, null where the numbers can't be."""
    n, m = nodes.cast("long"), edges.cast("long")
    return F.when((n > 0) & (n <= MOST_SEED) & (m >= 0) & (m <= MOST_SEED), 16 + 4 * (n + 1) + 8 * m)


def anatomy_bytes(nodes: Column) -> Column:
    """Bytes of an anatomy file."""
    n = nodes.cast("long")
    return F.when((n > 0) & (n <= MOST_SEED), 16 + 17 * n)


def collection(cards: DataFrame, area: str) -> DataFrame:
    """Cards of one area, or all for "Mixed"."""
    return cards.where((F.col("area") == area) | F.lit(area == "Mixed"))


def readiness(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """name, ready: whether the file that a manifest row (name, kind, nodes, edges) names is there (name, bytes) with just the bytes that its numbers imply."""
    want = F.when(F.col("kind") == "anatomy", anatomy_bytes(F.col("nodes"))).otherwise(graph_bytes(F.col("nodes"), F.col("edges")))
    return manifest.join(files, "name", "left").select("name", F.coalesce(want == F.col("bytes"), F.lit(False)).alias("ready"))
