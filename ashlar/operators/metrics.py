"""Structural metrics of code graphs: nodes (id, node_type, ...), edges (src, dst, edge_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import degrees, reach, strong_components

CONTROL = ("IF", "FOREACH", "WHILE")


def cyclomatic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cyclomatic) of methods and functions: 1 and the control flow they contain, at any depth."""
    own = nodes.where("node_type in ('METHOD', 'FUNCTION')").select("id")
    inside = reach(own, edges.where("edge_type = 'CONTAINS'")).where("hops > 0").select(F.col("start"), F.col("id").alias("inner"))
    flow = nodes.where(F.col("node_type").isin(*CONTROL)).select(F.col("id").alias("inner"))
    counted = inside.join(flow, "inner", "left_semi").groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return own.join(counted, "id", "left").select("id", (1 + F.coalesce("n", F.lit(0))).alias("cyclomatic"))


def _uses(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type in ('CALLS', 'DEPENDS')")


def hotspots(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k methods, functions and classes with the largest (fan_in + 1)(fan_out + 1)cyclomatic."""
    both = degrees(nodes, _uses(edges)).join(cyclomatic(nodes, edges), "id", "left")
    score = (F.col("fan_in") + 1) * (F.col("fan_out") + 1) * F.coalesce("cyclomatic", F.lit(1))
    both = both.join(nodes.where("node_type in ('METHOD', 'FUNCTION', 'CLASS')").select("id"), "id", "left_semi")
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def tangledness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the mean fan-out of the nodes and how many of them lie on a cycle."""
    out = degrees(nodes, _uses(edges)).agg(F.avg("fan_out").alias("mean_fan_out"))
    parts = strong_components(nodes, _uses(edges)).groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out.crossJoin(parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_cyclic")))  # one row each


def coupling(direct: Column, shared: Column, similarity: Column) -> Column:
    """Of two nodes: half for a direct edge, a tenth for each dependency shared, up to 0.4 for likeness; at most 1."""
    return F.least(F.lit(1.0), 0.5 * direct.cast("double") + 0.1 * shared + 0.4 * similarity)


def coupled_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, coupling) for pairs with an edge between them; likeness is equality of bodies.

    Dependencies shared are counted from the pairs that have an edge, not from all pairs.  Of each pair the end with fewer
    dependencies lists them, and a join asks whether the other end has them too: a hub's list is never one row nor copied to its
    pairs, and over all pairs at most edges^1.5 rows are asked about.
    """
    links = _uses(edges).select("src", "dst").where("src <> dst").distinct()
    pairs = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    uses = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    side = lambda k: nodes.select("id", F.when(F.col("body") != "", F.sha2("body", 256)).alias("body")).join(uses.withColumnRenamed("src", "id"), "id", "left").select(F.col("id").alias(k), F.col("body").alias(f"body_{k}"), F.coalesce("n", F.lit(0)).alias(f"n_{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    fewer = F.col("n_a") <= F.col("n_b")
    asked = joined.where("n_a > 0 and n_b > 0").select("a", "b", F.when(fewer, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(fewer, F.col("b")).otherwise(F.col("a")).alias("other"))
    asked = asked.join(links, "src").select("a", "b", F.col("other").alias("src"), "dst")
    shared = asked.join(links, ["src", "dst"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    alike = F.coalesce(F.col("body_a") == F.col("body_b"), F.lit(False)).cast("double")
    return joined.join(shared, ["a", "b"], "left").select("a", "b", coupling(F.lit(1), F.coalesce("shared", F.lit(0)), alike).alias("coupling"))


def quality_metrics(nodes: DataFrame) -> DataFrame:
    """One row: counts of methods and classes; mean and largest length, parameters and nesting of methods; methods per class."""
    own = F.col("node_type").isin("METHOD", "FUNCTION")
    of = lambda c: F.when(own, F.coalesce(F.col(c), F.lit(0)))
    counts = [F.count_if(own).alias("total_methods"), F.count_if(F.col("node_type") == "CLASS").alias("total_classes")]
    measures = [f(of(c)).alias(f"{k}_{n}") for c, n in (("line_count", "method_length"), ("param_count", "params"), ("nesting_depth", "nesting")) for k, f in (("avg", F.avg), ("max", F.max))]
    one = nodes.agg(*counts, *measures)
    return one.withColumn("methods_per_class", F.when(F.col("total_classes") > 0, F.col("total_methods") / F.col("total_classes")))


#: Points off per finding (fixed values); any other smell costs 3.
WEIGHTS = {"GOD_CLASS": 10, "CIRCULAR_DEPENDENCY": 15, "LONG_METHOD": 5, "DEEP_NESTING": 5, "FEATURE_ENVY": 3, "DEAD_CODE": 2, "LONG_PARAMETER_LIST": 3, "DUPLICATED_CODE": 8, "SPAGHETTI": 7, "SHOTGUN_SURGERY": 5}
#: Names under which the detectors' findings are weighed.
SAME_AS = {"GOD_OBJECT": "GOD_CLASS", "ARROW_CODE": "DEEP_NESTING", "COPY_PASTE": "DUPLICATED_CODE"}


#: How urgent a smell found or a metric over its bound is, in the order in which they are given (fixed values).
BY_SMELL = (("GOD_CLASS", "CRITICAL"), ("CIRCULAR_DEPENDENCY", "CRITICAL"), ("LONG_METHOD", "HIGH"), ("DEEP_NESTING", "HIGH"), ("FEATURE_ENVY", "MEDIUM"), ("DEAD_CODE", "LOW"))
BY_METRIC = (("avg_method_length", 30, "HIGH"), ("avg_params", 4, "MEDIUM"), ("methods_per_class", 10, "HIGH"))


def recommendations(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """(place, urgency, about, value, bound) of findings (smell) and the one row of ``metrics``, as listed; about is the smell or the metric, which has a value over its bound."""
    alike = F.create_map(*[F.lit(x) for kv in SAME_AS.items() for x in kv])
    found = findings.agg(F.collect_set(F.coalesce(F.element_at(alike, F.col("smell")), F.col("smell"))).alias("smells"))  # at most as many as there are kinds
    advice = lambda urgency, about, value, bound: F.struct(F.lit(urgency).alias("urgency"), F.lit(about).alias("about"), value.cast("double").alias("value"), F.lit(bound).cast("double").alias("bound"))
    rules = [F.when(F.array_contains("smells", s), advice(urgency, s, F.lit(None), None)) for s, urgency in BY_SMELL]
    rules += [F.when(F.col(c) > most, advice(urgency, c, F.col(c), most)) for c, most, urgency in BY_METRIC]
    one = metrics.crossJoin(found)  # one row each
    return one.select(F.posexplode(F.array(*rules)).alias("place", "advice")).where("advice is not null").select("place", "advice.*")


def score(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """The one row of ``metrics`` with ``score``, 100 less what findings (smell) and bad metrics cost, from 0 to 100."""
    names = F.create_map(*[F.lit(x) for k, v in SAME_AS.items() for x in (k, WEIGHTS[v])], *[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    cost = findings.agg(F.coalesce(F.sum(F.coalesce(F.element_at(names, F.col("smell")), F.lit(3))), F.lit(0)).alias("cost"))
    length = F.greatest(F.coalesce("avg_method_length", F.lit(0.0)) - 30, F.lit(0.0)) * 0.5
    nesting = F.greatest(F.coalesce("max_nesting", F.lit(0)) - 4, F.lit(0)) * 3
    total = F.lit(100.0) - F.col("cost") - length - nesting
    return metrics.crossJoin(cost).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))).drop("cost")  # one row each
