"""Serial work in streams: rows of a key are taken one at a time, in the order of time and id, in whatever order and batch they arrive.

Rows wait in a list state until the watermark has passed them, so no earlier one can still come; then a fold takes them in order.
A fold may also name a time at which it has something to do without any row (a run that ends, a state that can be forgotten);
a timer wakes it then. Thus the stream's answer is that of one sort over all rows, apart from rows later than the watermark, which
Spark drops. State is a key's waiting rows and what its fold keeps, and is cleared when the fold keeps nothing.
A failed batch is repeated from the state before it. One key is one task's work, as its rows depend on each other.

Folds keep times in microseconds. Needs the RocksDB state store; ``started`` sees to that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import sessions

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """What is done with a key's rows. ``kept``: schema of the state; ``out``: schema of the results, without the key."""

    kept: str
    out: str

    def take(self, state: tuple | None, at: int, number: int, kind: str | None) -> tuple[tuple | None, list[tuple]]:
        """State and results after one row."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When ``lapse`` is to be called if no row comes before."""
        return None

    def lapse(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        return None, []


class Admission(Fold):
    """At most ``limit`` admitted rows within ``seconds``; refused ones don't count. A state is forgotten when its last admitted row no longer counts."""

    kept, out = "recent array<long>", "event_id long, admitted boolean"

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.span = limit, round(seconds * 1e6)

    def take(self, state, at, number, kind):
        recent = [t for t in (state[0] if state else []) if at - t < self.span]
        ok = len(recent) < self.limit
        return ([*recent, at] if ok else recent,), [(number, ok)]

    def due(self, state):
        return max(state[0]) + self.span if state[0] else None


class Changes(Fold):
    """Rows whose kind differs from the one before. With ``forget`` seconds, a key that was silent for as long begins anew; without, its last kind is kept for good."""

    kept, out = "kind string, at long", "event_id long"

    def __init__(self, forget: float | None = None) -> None:
        self.forget = forget

    def take(self, state, at, number, kind):
        return (kind, at), [(number,)] if state and state[0] != kind else []

    def due(self, state):
        return None if self.forget is None else state[1] + round(self.forget * 1e6)


class Sessions(Fold):
    """Commands to a replaying session (see ``operators.sessions``), each answered once: a run when it is complete or superseded."""

    kept = "model boolean, steps long, run long, at long, kind string"
    out = "event_id long, command string, problem string, first_step long, frames long, last_step long, status string"

    def __init__(self, tick: int = sessions.TICK) -> None:
        self.tick = tick

    def take(self, state, at, number, kind):
        model, steps, run, begun, running = state or (False, 0, None, None, None)
        out: list[tuple] = []
        frames = 0 if run is None else min((sessions.MOST - steps) // sessions.PER_FRAME, -(-(at - begun) // self.tick))
        if kind == "export":
            return (model, steps, run, begun, running), [self.answer(number, kind, model, steps + sessions.PER_FRAME * frames)]
        if run is not None:
            out.append((run, running, None, steps, frames, steps + sessions.PER_FRAME * frames, "superseded"))
            steps += sessions.PER_FRAME * frames
        if kind == "train":
            model, steps = True, 0
        elif kind == "start" and model:
            steps = 0
        if kind in sessions.RUNS and model:
            return (model, steps, number, at, kind), out
        return (model, steps, None, None, None), [*out, self.answer(number, kind, model, steps)]

    @staticmethod
    def answer(number, kind, model, steps):
        problem = None if model else sessions.PROBLEMS.get(kind)
        if kind not in sessions.COMMANDS:
            problem = sessions.UNKNOWN
        status = "downloaded" if kind == "export" and model else "paused" if model else "ready"
        return number, kind, problem, steps, 0, steps, status

    def due(self, state):
        return None if state[2] is None else state[3] + (sessions.MOST - state[1]) // sessions.PER_FRAME * self.tick

    def lapse(self, state):
        model, steps, run, _, running = state
        return (model, sessions.MOST, None, None, None), [(run, running, None, steps, (sessions.MOST - steps) // sessions.PER_FRAME, sessions.MOST, "complete")]


class Serial(StatefulProcessor):
    """Runs a fold over rows (at, number, kind) of each key."""

    def __init__(self, fold: Fold, names: list[str]) -> None:
        self.fold, self.names = fold, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, number long, kind string")
        self.state = handle.getValueState("state", self.fold.kept)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            pdf = pdf[pdf["counts"]]
            new = [(int(a), int(n), None if k is None or k != k else k) for a, n, k in zip(pdf["at"], pdf["number"], pdf["kind"], strict=True)]
            if new:
                self.waiting.appendList(new)
                first = min([x[0] for x in new] + ([] if first is None else [first]))
        self.wake(first)
        return iter(())

    def wake(self, at: int | None) -> None:
        if at is not None:
            self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1], r[2] or "")) if self.waiting.exists() else []
        state = tuple(self.state.get()) if self.state.exists() else None
        ready = [r for r in rows if r[0] <= passed]
        out: list[tuple] = []

        def lapses(state: tuple | None, until: int) -> tuple | None:
            while state is not None and (due := self.fold.due(state)) is not None and due <= until:
                state, got = self.fold.lapse(state)
                out.extend(got)
            return state

        for at, number, kind in ready:
            state, got = self.fold.take(lapses(state, at), at, number, kind)
            out.extend(got)
        state = lapses(state, passed)
        if ready:
            self.waiting.clear()
            if len(rows) > len(ready):
                self.waiting.put([tuple(r) for r in rows[len(ready) :]])
                self.wake(rows[len(ready)][0])
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            self.wake(self.fold.due(state))
        if out:
            yield pd.DataFrame({name: pd.Series(col, dtype=object) for name, col in zip(self.names, [[key[0]] * len(out), *zip(*out, strict=True)], strict=True)})

    def close(self) -> None:
        pass


def folded(rows: DataFrame, fold: Fold, key: str, time: str, number: str, kind: str, late: str = "10 minutes") -> DataFrame:
    """``key`` and the fold's results, for a stream of rows. Rows without a time or a number have no place in the order and are left out (without a number they still move the watermark); a null key is a key."""
    when = F.col(time).cast("timestamp")
    # keys travel as text that is never null: of a frame with a null key, pandas would make numbers of other kinds
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    known = rows.where(F.col(time).isNotNull()).select(name.alias("__key"), when.alias("__ts"), F.unix_micros(when).alias("at"), F.coalesce(F.col(number).cast("long"), F.lit(0)).alias("number"), F.col(number).isNotNull().alias("counts"), F.col(kind).cast("string").alias("kind"))
    names = ["__key", *(x.split()[0] for x in fold.out.split(", "))]
    got = known.withWatermark("__ts", late).groupBy("__key").transformWithStateInPandas(Serial(fold, names), f"__key string, {fold.out}", "Append", "EventTime")
    return got.select(F.when(F.col("__key") != "", F.substr("__key", F.lit(2))).cast(rows.schema[key].dataType).alias(key), *names[1:])


def started(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream's rows as Parquet until its input is used up; a batch that is repeated is written once."""
    conf = rows.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)
