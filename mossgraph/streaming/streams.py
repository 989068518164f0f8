"""Streaming forms: limits per key, windowed activity, change detection, bounded traces, transactional publishing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type; late rows are dropped after the watermark."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def admitted(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """event_id, admitted: sliding-window admission by user, at once, trigger by trigger in the order of arrival; refused rows don't count. The state of a user is the last ``limit`` admitted times, kept for good. ``serial.Admission`` waits for the watermark instead, so its order is that of time, and forgets."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        pdf = pd.concat(frames).sort_values(["ts", "event_id"])
        out = []
        for t in pdf["ts"].map(lambda x: x.timestamp()):
            recent = [r for r in recent if t - r < seconds]
            out.append(len(recent) < limit)
            if out[-1]:
                recent.append(t)
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "admitted": out})
        state.update((recent,))

    return events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id").applyInPandasWithState(step, "event_id long, admitted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def changes(events: DataFrame) -> DataFrame:
    """event_id of rows whose type differs from the user's one before, across batches, at once; ``serial.Changes`` does so in the order of time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        known = state.exists
        out = []
        for i, kind in pd.concat(frames).sort_values(["ts", "event_id"])[["event_id", "event_type"]].itertuples(index=False):
            if known and kind != last:
                out.append(i)
            last, known = kind, True
        yield pd.DataFrame({"event_id": pd.Series(out, dtype="int64")})
        state.update((last,))

    return events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(step, "event_id long", "last string", "append", GroupStateTimeout.NoTimeout)


def frames(ticks: DataFrame, step: Callable[[int], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """One frame for each tick, written by batches: a batch that is repeated overwrites its own folder, so each appears once."""

    def emit(batch: DataFrame, number: int) -> None:
        for row in batch.select("value").orderBy("value").collect():  # ticks of one trigger
            step(row["value"]).write.mode("overwrite").parquet(f"{path}/step={row['value']}")

    return ticks.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Generations:
    """Newer work supersedes older: results are published only by the latest generation."""

    def __init__(self) -> None:
        self.now = 0
        self.running: StreamingQuery | None = None

    def begin(self) -> int:
        if self.running is not None:
            self.running.stop()
            self.running = None
        self.now += 1
        return self.now

    def publish(self, token: int, rows: DataFrame, path: str) -> bool:
        """Writes a version's folder if ``token`` is still current."""
        if token != self.now:
            return False
        rows.write.mode("overwrite").parquet(f"{path}/version={token}")
        return True
