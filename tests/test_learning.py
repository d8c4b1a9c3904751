import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.operators import learning
from ashlar.streaming import learning as stream_learning


def folded(steps):
    c, n = 0.5, 0
    for kind, amount in steps:
        if kind == "observe":
            c, n = min(1.0, c + (amount or 0)), n + 1
        elif kind == "good":
            c = min(1.0, c + 0.2)
        elif kind == "bad":
            c = max(0.1, c - 0.15)
        else:
            c *= 0.855 if n < 3 else 0.95
    return c, n


def some_events(n, names, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(names), i, rng.choice(["observe", "good", "bad", "decay", "decay"]), rng.choice([0.1, 0.05, None])) for i in range(n)]


def test_composition_is_associative_and_right():
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 64, 129):
        steps = [(rng.choice(["observe", "good", "bad", "decay"]), 0.1) for _ in range(n)]
        got = stream_learning.applied(0.5, 0, [k for k, _ in steps], [a for _, a in steps])
        assert np.allclose(got, folded(steps))
        half = stream_learning.applied(*stream_learning.applied(0.5, 0, [k for k, _ in steps[: n // 2]] + ["bad"], [0.1] * (n // 2 + 1)), ["bad", *[k for k, _ in steps[n // 2 :]]], [0.1] * (n - n // 2 + 1))
        assert np.allclose(half, folded(steps[: n // 2] + [("bad", 0), ("bad", 0)] + steps[n // 2 :]))


@pytest.mark.parametrize("hot", [10**6, 100, 0])
@pytest.mark.parametrize("names", [["a"], ["a", "b", None], [str(i) for i in range(700)]])
def test_fold_of_any_spread(spark, names, hot):
    rows = some_events(3000, names)
    df = spark.createDataFrame(rows, "name string, seq long, kind string, amount double").repartition(7)
    got = {r.name: (r.confidence, r.observations) for r in learning.fold(df, hot).collect()}
    assert set(got) == {r[0] for r in rows}
    for name in got:
        assert np.allclose(got[name], folded([(k, a) for x, _, k, a in rows if x == name]))


def test_fold_goes_over_several_tasks(spark):
    rows = some_events(4000, ["hot"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        df = spark.createDataFrame(rows, "name string, seq long, kind string, amount double")
        (r,) = learning.fold(df, 1000).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert np.allclose((r.confidence, r.observations), folded([(k, a) for _, _, k, a in rows]))


def test_fold_of_nothing(spark):
    assert learning.fold(spark.createDataFrame([], "name string, seq long, kind string, amount double")).collect() == []


def test_stream_with_a_restart_equals_the_batch(spark, sf_dir, tmp_path):
    kind = F.when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "error", "bad").otherwise("observe")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), F.lit(0.1).alias("amount"))
    rows = sorted(events.collect(), key=lambda r: r.ts)
    cut = len(rows) // 3
    # every batch has some events of a while ago; the last tells that time has passed
    parts = [rows[:cut], rows[cut : 2 * cut], rows[2 * cut :]]
    parts[1], parts[0] = parts[1] + parts[0][-5:], parts[0][:-5]
    (tmp_path / "in").mkdir()
    spark.conf.set(*stream_learning.STATE_STORE)
    try:

        def run(part, n):
            spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
            out = stream_learning.learned(stream, 24, "12 hours")

            def keep(batch, number):
                batch.write.mode("append").parquet(str(tmp_path / "out"))

            q = out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()  # each part is a query of its own, begun anew from the checkpoint

        for n, part in enumerate(parts):
            run(part, n)
        end = max(r.ts for r in rows)
        tick = spark.createDataFrame([("tick", end, 10**9, "observe", 0.1)], events.schema).select("name", (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), "seq", "kind", "amount").collect()
        run(tick, 3)
        got = {r.name: (r.epoch, r.confidence, r.observations) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("epoch").collect() if r.name != "tick"}
    finally:
        spark.conf.unset(stream_learning.STATE_STORE[0])
    last = max(x[0] for x in got.values())
    assert {x[0] for x in got.values()} == {last} and last > end
    batch = learning.fold(learning.with_epochs(events, 24, F.lit(last)))
    want = {r.name: (r.confidence, r.observations) for r in batch.collect()}
    assert set(got) == set(want)
    for name, (c, n) in want.items():
        assert abs(got[name][1] - c) < 1e-9 and got[name][2] == n
