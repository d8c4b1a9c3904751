"""Failure explanation: one plan from the log and the graph to cause and suggestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import graph, trace


def explain_last(log: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """One row (or none): the last failure with its upstream nodes, earlier failures of the node, cause (a struct) and suggestion."""
    last = trace.last_failure(log).select("execution_id", "node_id", "error", "ts")
    before = log.where(~F.col("success")).groupBy("node_id").agg((F.count(F.lit(1)) - 1).alias("failures_before"))
    up = graph.upstream(last.select(F.col("node_id").alias("id")), edges, hops).groupBy(F.col("start").alias("node_id")).agg(F.sort_array(F.collect_set("id")).alias("upstream"))
    steps = log.join(F.broadcast(last.select("execution_id")), "execution_id")  # one row
    order = F.sort_array(F.collect_list(F.struct("ts", "success")))
    failed_at = steps.groupBy("execution_id").agg((F.array_position(F.transform(order, lambda s: s["success"]), False) - 1).alias("failed_at"))
    rows = last.join(before, "node_id").join(up, "node_id", "left").join(failed_at, "execution_id")
    rows = rows.withColumn("upstream", F.coalesce("upstream", F.array().cast("array<string>")))
    rows = rows.withColumn("cause", rules.root_cause(F.col("node_id"), F.coalesce("error", F.lit("unknown")), F.col("upstream"), F.col("failures_before"), F.col("failed_at")))
    return rows.withColumn("suggestion", rules.suggestion(F.col("cause")))
