"""Learning from ordered events: confidences that observations, feedback and decay move, folded in order.

A pattern's events pass through one task in their order, one state in memory.  Those of a pattern with very many are folded in parallel: an event is a map x -> min(high, max(low, a x + b)) of the confidence.  Two such maps, one after the other, are such a map again, so stretches of
events are composed where they lie and only one map per task and pattern meets the others.  Decay depends on whether a pattern was observed
three times by then; a map is therefore kept for each number of observations (0, 1, 2, more) it may begin with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Confidence at first, what good and bad feedback do and how far, decay an epoch, decay of a pattern observed less than ENOUGH times.
START, GOOD, HIGHEST, BAD, LOWEST, DECAY, YOUNG_DECAY, ENOUGH = 0.5, 0.2, 1.0, 0.15, 0.1, 0.95, 0.855, 3

#: A pattern with more events is folded in parallel.
HOT = 1_000_000

_PARTS = ("a", "b", "low", "high")
_MAPS = "n long, " + ", ".join(f"{p} array<double>" for p in _PARTS)


def elements(kinds: np.ndarray, amounts: np.ndarray) -> dict[str, np.ndarray]:
    """The maps of events: n (observations added) and, by the number of observations before (0 to ENOUGH), a, b, low and high."""
    observe, good, bad = (kinds == k for k in ("observe", "good", "bad"))
    decay = ~(observe | good | bad)
    wide = lambda x: np.repeat(x[:, None], ENOUGH + 1, axis=1)
    a = np.where(decay[:, None], np.array([*[YOUNG_DECAY] * ENOUGH, DECAY]), 1.0)
    b = wide(np.select([observe, good, bad], [amounts, GOOD, -BAD], 0.0))
    low = wide(np.where(bad, LOWEST, -np.inf))
    high = wide(np.where(observe | good, HIGHEST, np.inf))
    return {"n": observe.astype(np.int64), "a": a, "b": b, "low": low, "high": high}


def then(f: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """f and afterwards g, row by row."""
    after = np.minimum(ENOUGH, np.arange(ENOUGH + 1) + f["n"][:, None])
    a, b, low, high = (np.take_along_axis(g[p], after, axis=1) for p in _PARTS)
    return {"n": f["n"] + g["n"], "a": a * f["a"], "b": a * f["b"] + b, "low": np.clip(a * f["low"] + b, low, high), "high": np.clip(a * f["high"] + b, low, high)}


def composed(maps: dict[str, np.ndarray], groups: np.ndarray) -> dict[str, np.ndarray]:
    """One map for each run of equal ``groups``: neighbours are composed pair by pair until each run is one row."""
    while len(groups):
        starts = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1))
        if len(starts) == len(groups):
            break
        place = np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups))))
        left = np.flatnonzero(place % 2 == 0)
        paired = left[np.append(left[1:] - left[:-1], len(groups) - left[-1]) == 2]
        new = {p: v.copy() for p, v in maps.items()}
        for p, v in then({p: v[paired] for p, v in maps.items()}, {p: v[paired + 1] for p, v in maps.items()}).items():
            new[p][paired] = v
        maps, groups = {p: v[left] for p, v in new.items()}, groups[left]
    return maps


def _of_batch(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    if "kind" in batch.schema.names:
        return elements(np.array(batch.column("kind").to_pylist(), dtype=object), batch.column("amount").fill_null(0.0).to_numpy(zero_copy_only=False))
    flat = {p: batch.column(p).flatten().to_numpy(zero_copy_only=False).reshape(-1, ENOUGH + 1) for p in _PARTS}
    return {"n": batch.column("n").to_numpy(zero_copy_only=False), **flat}


def _runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, part, maps) for runs of rows of one name: a run may go over any number of batches, of which one at a time is held."""
    part = TaskContext.get().partitionId()
    open_name, open_map = None, None

    def told(names: list, maps: dict[str, np.ndarray]) -> pa.RecordBatch:
        lists = [pa.array(list(maps[p]), pa.list_(pa.float64())) for p in _PARTS]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([part] * len(names), pa.int64()), pa.array(maps["n"]), *lists], names=["name", "part", "n", *_PARTS])

    for batch in stream:
        if not batch.num_rows:
            continue
        coded = batch.column("name").dictionary_encode(null_encoding="encode")
        codes, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        names, maps = [known[c] for c in codes[starts]], composed(_of_batch(batch), codes)
        if open_map is not None:
            if names[0] == open_name:
                first = then(open_map, {p: v[:1] for p, v in maps.items()})
                maps = {p: np.concatenate([first[p], v[1:]]) for p, v in maps.items()}
            else:
                names, maps = [open_name, *names], {p: np.concatenate([open_map[p], v]) for p, v in maps.items()}
        if len(names) > 1:
            yield told(names[:-1], {p: v[:-1] for p, v in maps.items()})
        open_name, open_map = names[-1], {p: v[-1:] for p, v in maps.items()}
    if open_map is not None:
        yield told([open_name], open_map)


def step(confidence: float, observations: int, kind: str | None, amount: float | None) -> tuple[float, int]:
    """Confidence and observations after one event."""
    if kind == "observe":
        return min(HIGHEST, confidence + (amount or 0.0)), observations + 1
    if kind == "good":
        return min(HIGHEST, confidence + GOOD), observations
    if kind == "bad":
        return max(LOWEST, confidence - BAD), observations
    return confidence * (YOUNG_DECAY if observations < ENOUGH else DECAY), observations


def _in_order(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, confidence, observations) of runs of rows of one name."""
    name, state = None, None
    for batch in stream:
        done: list[tuple] = []
        for own, kind, amount in zip(*(batch.column(c).to_pylist() for c in ("name", "kind", "amount")), strict=True):
            if state is None or own != name:
                if state is not None:
                    done.append((name, *state))
                name, state = own, (START, 0)
            state = step(*state, kind, amount)
        yield _figures(done)
    if state is not None:
        yield _figures([(name, *state)])


def _figures(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64()))], names=["name", "confidence", "observations"])


def fold(events: DataFrame, hot: int = HOT) -> DataFrame:
    """(name, confidence, observations) after events (name, seq, kind, amount), in the order of seq, then kind, then amount.

    observe adds amount up to 1; good adds 0.2 up to 1; bad takes 0.15 down to 0.1; any other kind is a decay, by 0.95 (0.855 under three
    observations).  Start: 0.5; a null amount is 0.  Events of a pattern with more than ``hot`` are ranged by name and order, so one with a third of all events is spread
    over a third of the tasks; each sends one map on.  Such figures may differ from those of a fold one by one in the last digits of a double.
    """
    kind = dict(events.dtypes)["name"]
    rows = events.select(F.col("name").cast("string").alias("name"), "seq", "kind", F.col("amount").cast("double").alias("amount"))
    order = ["name", "seq", "kind", "amount"]
    many = cut(rows.groupBy("name").count().where(F.col("count") > hot).select(F.col("name").alias("hot_name")))  # no more of them than events / hot
    is_hot = F.col("name").eqNullSafe(F.col("hot_name"))
    cold = rows if many.isEmpty() else rows.join(F.broadcast(many), is_hot, "left_anti")
    figures = cold.repartition("name").sortWithinPartitions(*order).select("name", "kind", "amount").mapInArrow(_in_order, "name string, confidence double, observations long")
    if not many.isEmpty():
        runs = rows.join(F.broadcast(many), is_hot, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, f"name string, part long, {_MAPS}")
        whole = runs.repartition("name").sortWithinPartitions("name", "part").mapInArrow(_runs, f"name string, part long, {_MAPS}")
        at_start = F.greatest(F.col("low")[0], F.least(F.col("high")[0], F.col("a")[0] * START + F.col("b")[0]))
        figures = figures.unionByName(whole.select("name", at_start.alias("confidence"), F.col("n").alias("observations")))
    return figures.withColumn("name", F.col("name").cast(kind))


def with_epochs(events: DataFrame, hours: int, until) -> DataFrame:
    """Events (name, ts, seq, kind, amount) before the last whole epoch up to ``until`` (a timestamp column), and a decay of each pattern at each epoch's end from
    its first event on; ``seq`` becomes (ts, seq), a decay before all else at its time.  Epochs are counted from 1970.
    """
    size = hours * 3_600_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    last = F.floor(F.unix_micros(until.cast("timestamp")) / size) * size
    timed = events.withColumn("at", micros).where(F.col("at") < last)
    ends = timed.groupBy("name").agg(F.min("at").alias("first"))
    ends = ends.select("name", F.explode(F.sequence(F.floor(F.col("first") / size) * size + size, last, F.lit(size))).alias("at"))
    decays = ends.select("name", F.struct("at", F.lit(None).cast("long").alias("seq")).alias("seq"), F.lit("decay").alias("kind"), F.lit(None).cast("double").alias("amount"))
    return timed.select("name", F.struct("at", F.col("seq").cast("long").alias("seq")).alias("seq"), "kind", F.col("amount").cast("double").alias("amount")).unionByName(decays)
