"""Commands to replaying sessions, one at a time: which run makes which frames until the next command supersedes it.

A session takes its commands in the order of time and id. ``train`` teaches a model and resets the steps; ``start`` runs from step 0,
``resume`` from where the last run ended; ``pause`` and ``controls`` stop. Every command but ``export`` supersedes a run before it,
whether it succeeds or not; a failing command doesn't hinder the next. A run makes a frame of ``PER_FRAME`` steps at once and after
every ``tick`` microseconds, strictly before the next command, up to ``MOST`` steps; it is complete a tick after its last frame.
A frame is the state after its steps, so what a run shows are the rows of ``replay.replayed`` at those steps: nothing runs twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Steps of a frame, most steps of a session, microseconds between frames, messages.
PER_FRAME, MOST, TICK = 8, 2048, 80_000
PROBLEMS = {"start": "Read a corpus first", "controls": "Read a corpus first", "export": "No session to export", "resume": "No paused session"}
UNKNOWN = "Unknown worker command"

RUNS = ("start", "resume")
COMMANDS = ("train", "start", "resume", "pause", "controls", "export")


def answered(commands: DataFrame, key: str, time: str, number: str, kind: str, tick: int = TICK) -> DataFrame:
    """``key``, event_id, command, problem, first_step, frames, last_step, status of every command. Rows without a time or a number are left out; a null key is a session.

    Status: a run is complete or superseded, an export downloaded; after anything else the session is paused, or ready if it has no model.
    A session's rows are sorted in one task, as each depends on those before; sorts spill.
    """
    rows = commands.where(F.col(time).isNotNull() & F.col(number).isNotNull()).select(F.col(key), F.unix_micros(F.col(time).cast("timestamp")).alias("__at"), F.col(number).cast("long").alias("event_id"), F.col(kind).cast("string").alias("command"))
    rows = rows.withColumn("__tie", F.coalesce("command", F.lit("")))
    order = W.partitionBy(key).orderBy("__at", "event_id", "__tie")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    interrupts = ~F.col("command").eqNullSafe("export")
    rows = rows.withColumns({"__model": F.coalesce(F.max(F.col("command") == "train").over(so_far), F.lit(False)), "__stop": F.when(interrupts, F.col("__at"))})
    rows = rows.withColumn("__next", F.expr(f"lead(__stop) IGNORE NULLS OVER (PARTITION BY `{key}` ORDER BY __at, event_id, __tie)"))
    known = F.coalesce(F.col("command").isin(*COMMANDS), F.lit(False))
    rows = rows.withColumns({"__runs": F.coalesce(F.col("command").isin(*RUNS) & F.col("__model"), F.lit(False)), "__epoch": F.count(F.when((F.col("command") == "train") | ((F.col("command") == "start") & F.col("__model")), 1)).over(so_far)})
    most = MOST // PER_FRAME
    wanted = F.when(F.col("__runs"), F.least(F.lit(most), F.coalesce(F.ceil((F.col("__next") - F.col("__at")) / tick), F.lit(most)))).otherwise(0)
    rows = rows.withColumn("__wanted", wanted)
    within = W.partitionBy(key, "__epoch").orderBy("__at", "event_id", "__tie")
    before = F.coalesce(F.sum("__wanted").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # an export doesn't end a run: it finds the frames that the run has made by then
    earlier = within.rowsBetween(W.unboundedPreceding, -1)
    last = lambda what: F.last(F.when(interrupts, what), True).over(earlier)
    run = F.least(F.lit(most), before - F.coalesce(last(F.col("__wanted")), F.lit(0)))
    made = F.when(F.coalesce(last(F.col("__runs")), F.lit(False)), F.ceil((F.col("__at") - last(F.col("__at"))) / tick)).otherwise(0)
    first = F.when(interrupts, F.least(F.lit(most), before)).otherwise(F.least(F.lit(most), run + made))
    rows = rows.withColumn("__first", first).withColumn("__frames", F.least(F.col("__wanted"), most - F.col("__first")))
    problem = F.when(~known, UNKNOWN)
    for name, text in PROBLEMS.items():
        problem = problem.when((F.col("command") == name) & ~F.col("__model"), text)
    complete = F.col("__next").isNull() | (F.col("__next") >= F.col("__at") + (most - F.col("__first")) * tick)
    status = F.when(F.col("__runs"), F.when(complete, "complete").otherwise("superseded")).when(~F.col("__model"), "ready").when(F.col("command") == "export", "downloaded").otherwise("paused")
    steps = lambda x: (PER_FRAME * x).cast("long")
    return rows.select(key, "event_id", "command", problem.alias("problem"), steps(F.col("__first")).alias("first_step"), F.col("__frames").cast("long").alias("frames"), steps(F.col("__first") + F.col("__frames")).alias("last_step"), status.alias("status"))


def shown(runs: DataFrame, key: str, cue: str, replayed: DataFrame, card: str) -> DataFrame:
    """``key``, event_id, frame and the replay's columns for every frame of ``runs`` (of ``answered``, with a ``cue``): ``replayed`` (``card``, step, ...) is computed once a card, however many sessions show it."""
    each = runs.where("frames > 0").select(key, "event_id", F.col(cue).alias("__cue"), "first_step", F.explode(F.sequence(F.lit(1), F.col("frames").cast("int"))).alias("frame"))
    each = each.select(key, "event_id", "__cue", "frame", (F.col("first_step") + PER_FRAME * F.col("frame")).alias("__step"))
    return each.join(replayed, (F.col("__cue") == F.col(card)) & (F.col("__step") == F.col("step"))).drop("__cue", "__step")
