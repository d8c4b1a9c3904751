"""Analytics of an execution log: (execution_id, node_id, duration_ms, success, error, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def node_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("node_id").agg(F.count(F.lit(1)).alias("executions"), F.avg("duration_ms").alias("avg_duration"), F.max("duration_ms").alias("max_duration"), F.count_if(~F.col("success")).alias("failures"))


def slowest_nodes(log: DataFrame, k: int | None = 10) -> DataFrame:
    """The ``k`` slowest nodes, or all if ``k`` is None, slowest first."""
    ranked = node_stats(log).orderBy(F.desc("avg_duration"), "node_id")
    return ranked if k is None else ranked.limit(k)


def last_failure(log: DataFrame, node: str | None = None) -> DataFrame:
    """The latest failure (of a node); of several at one time the one of least execution and node."""
    failed = log.where(~F.col("success"))
    return (failed if node is None else failed.where(F.col("node_id") == node)).orderBy(F.desc("ts"), "execution_id", "node_id").limit(1)


def failures_of_others(log: DataFrame, node: str, k: int = 10) -> DataFrame:
    return log.where(~F.col("success") & (F.col("node_id") != node)).orderBy(F.desc("ts"), "execution_id", "node_id").limit(k)


def recent_successes(log: DataFrame, node: str, k: int = 10) -> DataFrame:
    """Executions in which the node succeeded, latest first."""
    return log.where(F.col("success") & (F.col("node_id") == node)).groupBy("execution_id").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "execution_id").limit(k)


def trace_paths(log: DataFrame) -> DataFrame:
    """(execution_id, path, n_steps): node ids in the order of time."""
    steps = F.sort_array(F.collect_list(F.struct("ts", "node_id")))
    return log.groupBy("execution_id").agg(F.transform(steps, lambda s: s["node_id"]).alias("path")).withColumn("n_steps", F.size("path").cast("long"))


def transitions(log: DataFrame) -> DataFrame:
    """(execution_id, src, dst): consecutive steps."""
    w = Window.partitionBy("execution_id").orderBy("ts", "node_id")
    return log.select("execution_id", F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst")).where(F.col("dst").isNotNull())


def steps(log: DataFrame) -> DataFrame:
    """Every row of the log with ``step``: its place in its execution, from 0."""
    return log.withColumn("step", F.row_number().over(Window.partitionBy("execution_id").orderBy("ts", "node_id")) - 1)


def run_lengths(log: DataFrame) -> DataFrame:
    """(execution_id, node_id, run, n): consecutive steps at one node, runs counted from 1."""
    w = Window.partitionBy("execution_id").orderBy("ts", "node_id")
    marked = log.withColumn("new", F.coalesce((F.lag("node_id").over(w) != F.col("node_id")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w).cast("int"))
    return marked.groupBy("execution_id", "node_id", "run").agg(F.count(F.lit(1)).alias("n"))


def distinct_stats(log: DataFrame) -> DataFrame:
    """(node_id, executions, avg_duration) over the distinct (execution, node, duration) of the log."""
    return log.select("execution_id", "node_id", "duration_ms").distinct().groupBy("node_id").agg(F.count_distinct("execution_id").alias("executions"), F.avg("duration_ms").alias("avg_duration"))


def session_stats(sessions: DataFrame) -> DataFrame:
    """(session_id, executions, total_ms, mean_ms) of rows (session_id, duration_ms): the total over the number, 1 at least."""
    sums = sessions.groupBy("session_id").agg(F.count("duration_ms").alias("executions"), F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("total_ms"))
    return sums.withColumn("mean_ms", F.col("total_ms") / F.greatest("executions", F.lit(1)))


def divergence(a: Column, b: Column) -> Column:
    """First place at which two paths differ, counting from 0; null if one begins the other."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    differs = F.transform(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull() & (p["a"] != p["b"]))
    at = F.array_position(differs, True)
    return F.when(at > 0, at - 1)


def performance_rules(log: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """(node_id, action, speedup) by rule from node_stats and nodes (id, pure, executor), largest speedup first."""
    joined = node_stats(log).join(nodes.select(F.col("id").alias("node_id"), "pure", "executor"), "node_id")
    rate = F.col("failures") / F.col("executions")
    entry = lambda action, speedup: F.struct(F.lit(action).alias("action"), speedup.cast("double").alias("speedup"))
    rules = F.array_compact(
        F.array(
            F.when(rate > 0.1, entry("fix_errors", 1 + rate)),
            F.when(F.col("pure") & (F.col("avg_duration") > 10), entry("cache", F.least(F.col("avg_duration") / 0.1, F.lit(100.0)))),
            F.when((F.col("executor") == "SQL") & (F.col("avg_duration") > 50), entry("add_index", F.lit(5.0))),
        )
    )
    return joined.select("node_id", F.inline(rules)).orderBy(F.desc("speedup"), "node_id", "action").limit(k)


def cache_candidates(log: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    pure = nodes.where("pure").select(F.col("id").alias("node_id"))
    stats = log.where("success").join(pure, "node_id", "left_semi").groupBy("node_id").agg(F.count(F.lit(1)).alias("calls"), F.avg("duration_ms").alias("avg_ms"))
    return stats.where("calls > 10 AND avg_ms > 5").orderBy(F.desc(F.col("calls") * F.col("avg_ms")), "node_id").limit(k)


def co_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, src): two pure targets of one source, a before b, a not yet parallel."""
    pure = lambda k: nodes.where("pure").select(F.col("id").alias(k), F.col("parallelizable").alias(f"{k}_parallel"))
    links = edges.select("src", "dst").distinct()
    # the conditions on each end come before the pairs are made
    left = links.select("src", F.col("dst").alias("a")).join(pure("a").where("not a_parallel"), "a")
    return left.join(links.select("src", F.col("dst").alias("b")).join(pure("b"), "b"), "src").where("a < b").select("a", "b", "src")


def performance(log: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(node_id, action, speedup): the rules of performance_rules, parallel pairs (speedup 2 for the first target) and cache candidates (10), largest first."""
    pairs = co_targets(edges, nodes).select(F.col("a").alias("node_id"), F.lit("parallelize").alias("action"), F.lit(2.0).alias("speedup")).distinct()
    kept = cache_candidates(log, nodes).select("node_id", F.lit("cache_result").alias("action"), F.lit(10.0).alias("speedup"))
    return performance_rules(log, nodes, k).union(pairs).union(kept).orderBy(F.desc("speedup"), "node_id", "action").limit(k)
