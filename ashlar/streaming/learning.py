"""Learning while a stream runs: a state per pattern, observations that wait for their turn, a timer for each epoch's end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import learning

#: The state store that stateful processors need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "name string, epoch timestamp, confidence double, observations long"


class Learner(StatefulProcessor):
    """Folds a pattern's events in the order of their times, whatever order they come in.

    Events wait in a list until the watermark has passed the end of their epoch, when none of before can come any more; then they are applied in order, the
    pattern decays, and a row tells its confidence.  Idle patterns decay epoch by epoch.
    """

    def __init__(self, hours: int):
        self.size = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.learned = handle.getValueState("learned", "confidence double, observations long, epoch long")
        self.waiting = handle.getListState("waiting", "at long, seq long, kind string, amount double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = [(int(r.at), int(r.seq), r.kind, float(r.amount)) for frame in rows for r in frame.itertuples()]
        self.waiting.appendList(arrived)
        if not self.learned.exists():
            first = min(r[0] for r in arrived) // 1000 // self.size * self.size + self.size
            self.learned.update((learning.START, 0, first))
            self.handle.registerTimer(first)
        else:  # a pattern's first event may be older than the one it was begun by
            confidence, observations, end = self.learned.get()
            first = min(r[0] for r in arrived) // 1000 // self.size * self.size + self.size
            if first < end and not observations and confidence == learning.START:
                self.handle.deleteTimer(end)
                self.learned.update((confidence, observations, first))
                self.handle.registerTimer(first)
        return iter(())  # rows come with the timers

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        confidence, observations, end = self.learned.get()
        passed = timerValues.getCurrentWatermarkInMs()
        waiting, told = sorted(self.waiting.get()), []
        while end <= passed:
            due = [r for r in waiting if r[0] < end * 1000]
            waiting = waiting[len(due) :]
            confidence, observations = applied(confidence, observations, [r[2] for r in due] + ["decay"], [r[3] for r in due] + [0.0])
            told.append((key[0], pd.Timestamp(end, unit="ms"), confidence, observations))
            end += self.size
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        self.learned.update((confidence, observations, end))
        self.handle.registerTimer(end)
        yield pd.DataFrame(told, columns=["name", "epoch", "confidence", "observations"])

    def close(self) -> None:
        pass


def applied(confidence: float, observations: int, kinds: list[str], amounts: list[float]) -> tuple[float, int]:
    """Confidence and observations after some events in order."""
    maps = learning.composed(learning.elements(np.array(kinds, dtype=object), np.array(amounts, dtype=float)), np.zeros(len(kinds), dtype=np.int64))
    v = min(learning.ENOUGH, observations)
    new = float(np.clip(maps["a"][0, v] * confidence + maps["b"][0, v], maps["low"][0, v], maps["high"][0, v]))
    return new, observations + int(maps["n"][0])


def learned(events: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """A stream of (name, epoch, confidence, observations), a row per pattern and epoch, from a stream of events (name, ts, seq, kind, amount).

    Kinds are those of operators.learning.fold, which gives the same figures for with_epochs() of the same events.  Events may come ``late`` by so much and in
    any order; the watermark drops later ones.  The session needs STATE_STORE; a restart from the checkpoint goes on where it stopped.
    """
    timed = events.select(
        F.col("name").cast("string").alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"), "kind", F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount")
    )
    return timed.withWatermark("ts", late).groupBy("name").transformWithStateInPandas(Learner(hours), OUT, "Update", "EventTime")


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each pattern of what learned() has written."""
    return rows.groupBy("name").agg(F.max_by(F.struct("confidence", "observations"), "epoch").alias("x")).select("name", "x.confidence", "x.observations")
