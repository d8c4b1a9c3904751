"""Suggestions for a failed execution, by comparing its path with those of executions that went well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import trace


def suggest_fixes(log: DataFrame, nodes: DataFrame, node: str | None = None, k: int = 3) -> DataFrame:
    """(node_id, success_id, action, confidence, description) for the last failure (of ``node``), at most k rows.

    The k latest executions in which the failed node succeeded are compared step by step: a path that differs is a
    divergence, an equal one points to the input.  What the node's type suggests comes after them.  ``nodes``: id, node_type.
    """
    last = trace.last_failure(log, node).select("node_id", F.col("execution_id").alias("failed_id"))
    one = F.broadcast(last)  # a row at most
    good = log.join(one, "node_id", "left_semi").where("success").join(last.select(F.col("failed_id").alias("execution_id")), "execution_id", "left_anti")
    recent = good.groupBy("execution_id").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "execution_id").limit(k)
    wanted = recent.select("execution_id").union(last.select("failed_id")).distinct()
    paths = trace.trace_paths(log.join(F.broadcast(wanted), "execution_id", "left_semi")).select("execution_id", "path")  # k + 1 rows
    failed = last.join(paths.select(F.col("execution_id").alias("failed_id"), F.col("path").alias("failed_path")), "failed_id")
    both = recent.join(paths, "execution_id").crossJoin(F.broadcast(failed))
    at = trace.divergence(F.col("path"), F.col("failed_path"))
    both = both.withColumn("at", at)
    step = F.col("at").cast("int")
    differs = F.concat(F.lit("paths part at step "), step, F.lit(": "), F.col("path")[step], F.lit(" when it went well, "), F.col("failed_path")[step], F.lit(" when it failed"))
    compared = both.select(
        "node_id",
        F.col("execution_id").cast("string").alias("success_id"),
        F.when(F.col("at").isNull(), "check_input").otherwise("investigate_divergence").alias("action"),
        F.when(F.col("at").isNull(), 0.7).otherwise(0.5).alias("confidence"),
        F.when(F.col("at").isNull(), "the same path went well before: look at the input").otherwise(differs).alias("description"),
    )
    action = F.when(F.col("node_type") == "VALIDATE", "add_sanitizer").when(F.col("node_type") == "PERSIST", "check_constraints")
    typed = nodes.select(F.col("id").alias("node_id"), action.alias("action")).where("action is not null").join(F.broadcast(last), "node_id")
    typed = typed.select("node_id", F.lit(None).cast("string").alias("success_id"), "action", F.lit(0.4).alias("confidence"), F.concat("action", F.lit(" for "), "node_id").alias("description"))
    return compared.union(typed).orderBy(F.desc("confidence"), "success_id", "action").limit(k)
