"""Serial state in streams: rows out of order, in several batches, give the answer of the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from mossgraph.operators import guards, sessions
from mossgraph.streaming import serial

SCHEMA = "user_id string, event_id long, ts timestamp, event_type string"
DAY = 86_400.0


def rows(seed, kinds, n=400, users=("a", "b", None), span=40_000):
    rng = random.Random(seed)
    return [(rng.choice(users), k, round(rng.randrange(span) * rng.choice([1.0, 1.0, 0.001]), 6), rng.choice(kinds)) for k in range(n)]


def frame(spark, made):
    return spark.createDataFrame(made, "user_id string, event_id long, s double, event_type string").select("user_id", "event_id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "event_type")


def streamed(spark, where, made, fold, late, batches=4, seed=3):
    """Rows at most ``late`` seconds out of order, in batches, and an end that lets the watermark pass them."""
    rng = random.Random(seed)
    order = sorted(made, key=lambda r: r[2] + rng.random() * late)
    size = -(-len(order) // batches)
    parts = [order[k : k + size] for k in range(0, len(order), size or 1)] + [[(None, None, max((r[2] for r in made), default=0.0) + 90 * DAY, None)]]
    for k, part in enumerate(parts):
        rng.shuffle(part)
        frame(spark, part).coalesce(1).write.parquet(f"{where}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    out = serial.folded(stream, fold, "user_id", "ts", "event_id", "event_type", f"{late} seconds")
    q = serial.started(out, f"{where}/out", f"{where}/state")
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None
    assert len([p for p in q.recentProgress if p.numInputRows]) >= min(len(parts), 3)
    return spark.read.schema(out.schema).parquet(f"{where}/out")


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("tick", [100_000, 3_000_000])
def test_commands_in_any_order(spark, tmp_path, tick):
    made = rows(1, [*sessions.COMMANDS, "nonsense", None])
    got = streamed(spark, str(tmp_path), made, serial.Sessions(tick), 3000)
    want = sessions.answered(frame(spark, made), "user_id", "ts", "event_id", "event_type", tick)
    assert sorted(got.collect(), key=key) == sorted(want.select(got.columns).collect(), key=key)
    assert want.count() == len(made) and {r[0] for r in want.select("status").distinct().collect()} == {"complete", "superseded", "paused", "ready", "downloaded"}


def test_admission_in_any_order(spark, tmp_path):
    made = rows(2, ["x"], users=("a", "b", "c"))
    got = streamed(spark, str(tmp_path), made, serial.Admission(3, 700.0), 5000)
    want = guards.admitted(frame(spark, made), "user_id", "event_id", "ts", 3, 700.0)
    assert sorted(got.select("event_id", "admitted").collect()) == sorted(want.select("event_id", "admitted").collect())


@pytest.mark.parametrize("forget", [None, 900.0])
def test_changes_in_any_order(spark, tmp_path, forget):
    made = rows(4, ["x", "y", None])
    want, last = [], {}
    for u, i, s, k in sorted(made, key=lambda r: (r[2], r[1])):
        if u in last and (forget is None or round(s * 1e6) < round(last[u][1] * 1e6) + forget * 1e6) and last[u][0] != k:
            want.append(i)
        last[u] = k, s
    got = streamed(spark, str(tmp_path), made, serial.Changes(forget), 2000)
    assert sorted(r.event_id for r in got.collect()) == sorted(want)


def test_plain_session():
    """By hand: frames at 0, 10, 20; a pause at 25 ends a run after three; resuming goes on with the fourth."""
    fold = serial.Sessions(10)
    state, out = None, []
    for at, number, kind in [(0, 1, "start"), (0, 2, "train"), (0, 3, "start"), (25, 4, "pause"), (30, 5, "resume"), (31, 6, "export"), (40, 7, "bad"), (50, 8, "resume")]:
        state, got = fold.take(state, at, number, kind)
        out += got
    assert fold.due(state) == 50 + 252 * 10
    out += fold.lapse(state)[1]
    assert [(r[0], *r[2:]) for r in out] == [
        (1, "Read a corpus first", 0, 0, 0, "ready"), (2, None, 0, 0, 0, "paused"), (3, None, 0, 3, 24, "superseded"), (4, None, 24, 0, 24, "paused"),
        (6, None, 32, 0, 32, "downloaded"), (5, None, 24, 1, 32, "superseded"), (7, "Unknown worker command", 32, 0, 32, "paused"), (8, None, 32, 252, 2048, "complete")]


def test_shown_frames(spark):
    runs = spark.createDataFrame([("a", 1, 7, 16, 2), ("b", 2, 7, 0, 1), ("b", 3, 8, 0, 0)], "user_id string, event_id long, cue long, first_step long, frames long")
    steps = spark.createDataFrame([(c, s, c + s / 100) for c in (7, 8) for s in range(1, 65)], "item long, step int, rms double")
    got = sessions.shown(runs, "user_id", "cue", steps, "item").select("user_id", "event_id", "frame", "step", "rms")
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1, 24, 7.24), ("a", 1, 2, 32, 7.32), ("b", 2, 1, 8, 7.08)]


def test_no_rows(spark, tmp_path):
    assert streamed(spark, str(tmp_path), [], serial.Sessions(), 60).count() == 0
