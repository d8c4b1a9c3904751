"""Causal tracing over weighted edges: src, dst, latency, confidence, amplification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut
from .mining import correlations


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.col("confidence").alias("c"), F.col("amplification").alias("m"), F.col("latency").alias("l"))


def chains(starts: DataFrame, edges: DataFrame, most: int = 10, least: float = 0.3) -> DataFrame:
    """(start, id, hops, path, confidence, amplification, latency): simple paths from each start (id) whose
    confidence stays at ``least`` or more.  Pruning inside the expansion bounds the paths: at 0.8 an edge, five hops."""
    links = _links(edges)
    frontier = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"), F.array("id").alias("path"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("amplification"), F.lit(0).cast("long").alias("latency"))
    found = None
    for _ in range(most):
        step = frontier.join(links, frontier["id"] == links["src"]).where(~F.array_contains("path", F.col("dst")))
        frontier = step.select(
            "start",
            F.col("dst").alias("id"),
            (F.col("hops") + 1).alias("hops"),
            F.concat("path", F.array("dst")).alias("path"),
            (F.col("confidence") * F.col("c")).alias("confidence"),
            (F.col("amplification") * F.col("m")).alias("amplification"),
            (F.col("latency") + F.col("l")).cast("long").alias("latency"),
        ).where(F.col("confidence") >= least)
        frontier = cut(frontier)
        found = frontier if found is None else found.union(frontier)
        if frontier.isEmpty():
            break
    return found


def effects(starts: DataFrame, edges: DataFrame, most: int = 10, least: float = 0.3) -> DataFrame:
    """(start, id, hops, path, confidence, amplification, latency): for each node a start affects, the chain with fewest hops, then most
    confidence, then least path, of those whose confidence stays at ``least`` or more.

    A turn keeps one chain per start and node, the best of its length, and only if it is surer than all shorter ones: with confidences up to 1 no
    other can lead to a new node.  So rows grow with nodes, not with paths."""
    links = _links(edges).withColumnsRenamed({"src": "from", "dst": "to"})
    frontier = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"), F.array("id").alias("path"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("amplification"), F.lit(0).cast("long").alias("latency")).dropDuplicates(["start"])
    surest = cut(frontier.select("start", "id", "confidence"))
    found = frontier.limit(0)
    for hop in range(1, most + 1):
        step = frontier.join(links, frontier["id"] == links["from"]).where(~F.array_contains("path", F.col("to")))
        rows = step.select(
            "start",
            F.col("to").alias("id"),
            F.concat("path", F.array("to")).alias("path"),
            (F.col("confidence") * F.col("c")).alias("confidence"),
            (F.col("amplification") * F.col("m")).alias("amplification"),
            (F.col("latency") + F.col("l")).cast("long").alias("latency"),
        ).where(F.col("confidence") >= least)
        best = rows.groupBy("start", "id").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "path", "confidence", "amplification", "latency")).alias("b"))
        best = best.select("start", "id", F.lit(hop).alias("hops"), "b.path", "b.confidence", "b.amplification", "b.latency")
        known = surest.select("start", "id", F.col("confidence").alias("before"))
        frontier = cut(best.join(known, ["start", "id"], "left").where("before is null or confidence > before").drop("before"))
        if frontier.isEmpty():
            break
        found = found.union(frontier.join(surest, ["start", "id"], "left_anti").select(*found.columns))
        surest = cut(surest.union(frontier.select("start", "id", "confidence")).groupBy("start", "id").agg(F.max("confidence").alias("confidence")))
    return found


def root_causes(starts: DataFrame, edges: DataFrame, most: int = 10, least: float = 0.3) -> DataFrame:
    """As effects(), backwards: what may have caused each start; paths lead from the cause to the start."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence", "amplification", "latency")
    return effects(starts, turned, most, least).withColumn("path", F.reverse("path"))


def butterflies(starts: DataFrame, edges: DataFrame, criticality: DataFrame, least: float = 5.0) -> DataFrame:
    """Effects amplified ``least`` times or more, with criticality = amplification x the node's own (0.5 if it has none) x confidence."""
    found = effects(starts, edges).where(F.col("amplification") >= least).join(criticality.select("id", F.col("criticality").alias("own")), "id", "left")
    return found.select("start", "id", "hops", "amplification", (F.col("amplification") * F.coalesce("own", F.lit(0.5)) * F.col("confidence")).alias("criticality"))


def impact(starts: DataFrame, edges: DataFrame, criticality: DataFrame) -> DataFrame:
    """(start, direct, indirect, reach, max_depth, max_amplification, critical): how far a change spreads, and the five nodes whose amplification
    (over 2) is largest among those with amplification x own criticality over 1."""
    found = effects(starts, edges).join(criticality.select("id", "criticality"), "id", "left").withColumn("own", F.coalesce("criticality", F.lit(0.5)))
    critical = F.when((F.col("amplification") > 2) & (F.col("amplification") * F.col("own") > 1), F.struct((-F.col("amplification")).alias("s"), "id"))
    ranked = found.withColumn("critical", critical)
    first = Window.partitionBy("start").orderBy(F.col("critical").asc_nulls_last(), "id")
    few = ranked.withColumn("k", F.row_number().over(first)).where("k <= 5 and critical is not null").groupBy("start").agg(F.sort_array(F.collect_list("critical")).alias("c"))
    out = found.groupBy("start").agg(F.count_if(F.col("hops") == 1).alias("direct"), F.count_if(F.col("hops") > 1).alias("indirect"), F.count(F.lit(1)).alias("reach"), F.max("hops").alias("max_depth"), F.max("amplification").alias("max_amplification"))
    return out.join(few, "start", "left").select(*out.columns, F.coalesce(F.transform("c", lambda x: x["id"]), F.array().cast("array<string>")).alias("critical"))


def learned(observed: DataFrame, least: float = 0.3) -> DataFrame:
    """(src, dst, confidence, amplification, latency): edges learned from observed pairs (src, dst), their strength as confidence."""
    return correlations(observed, least).select("src", "dst", F.col("strength").alias("confidence"), F.lit(1.0).alias("amplification"), F.lit(0).cast("long").alias("latency"))


def reinforced(observed: DataFrame) -> DataFrame:
    """(src, dst, observations, confidence) of repeated observations (seq, src, dst, confidence): the first's confidence and 0.1 for each repeat, up to 1."""
    g = observed.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("observations"), F.min_by("confidence", "seq").alias("first"))
    return g.select("src", "dst", "observations", F.least(F.lit(1.0), F.col("first") + 0.1 * (F.col("observations") - 1)).alias("confidence"))
