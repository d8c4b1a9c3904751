"""Smell detectors over code graphs, one row a finding: (smell, id, confidence).

nodes: id, node_type, name, body, line_count, param_count; edges: src, dst, edge_type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut, strong_components
from .metrics import coupled_pairs, cyclomatic
from .search import similar_pairs

#: Names that are entered from outside, so that nothing need call them (fixed values).
ENTRY_NAMES = ("main", "__init__", "__main__", "run", "start", "execute")
#: Nesting at which the confidence of ARROW_CODE reaches 1.
DEEPEST = 6


def _found(rows: DataFrame, smell: str, confidence: Column) -> DataFrame:
    return rows.select(F.lit(smell).alias("smell"), F.col("id"), confidence.cast("double").alias("confidence"))


def _calls(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type = 'CALLS'").select("src", "dst").distinct()


def _methods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner, id): methods by the class that contains them."""
    methods = nodes.where("node_type = 'METHOD'").select("id")
    owners = nodes.where("node_type = 'CLASS'").select(F.col("id").alias("owner"))
    return edges.where("edge_type = 'CONTAINS'").select(F.col("src").alias("owner"), F.col("dst").alias("id")).distinct().join(methods, "id").join(owners, "owner")


def god_object(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = _calls(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    by_class = _methods(nodes, edges).join(out, "id", "left").groupBy("owner").agg(F.count(F.lit(1)).alias("m"), F.sum(F.coalesce("fan_out", F.lit(0))).alias("f"))
    return _found(by_class.where("m > 10 or f > 20").withColumnRenamed("owner", "id"), "GOD_OBJECT", F.least((F.col("m") / 15 + F.col("f") / 30) / 2, F.lit(1.0)))


def spaghetti(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One finding for the whole graph (id null): calls per node over 2."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    c = edges.where("edge_type = 'CALLS'").agg(F.count(F.lit(1)).alias("c"))
    ratio = F.col("c") / F.col("n")
    return _found(n.crossJoin(c).where("n > 0").where(ratio > 2).withColumn("id", F.lit(None).cast(nodes.schema["id"].dataType)), "SPAGHETTI", F.least(ratio / 4, F.lit(1.0)))  # one row each


def circular(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One finding for each component of more than one node, by its least id."""
    parts = strong_components(nodes, edges.where("edge_type in ('CALLS', 'DEPENDS')"))
    return _found(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("component", "id"), "CIRCULAR_DEPENDENCY", F.lit(1.0))


def feature_envy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    owner = _methods(nodes, edges)
    calls = owner.join(_calls(edges).withColumnRenamed("src", "id"), "id").join(owner.select(F.col("id").alias("dst"), F.col("owner").alias("theirs")), "dst", "left")
    same = F.coalesce(F.col("theirs") == F.col("owner"), F.lit(False))
    counted = calls.groupBy("id").agg(F.count_if(~same).alias("ext"), F.count_if(same).alias("own"))
    return _found(counted.where("ext > own and ext > 2"), "FEATURE_ENVY", F.least(F.col("ext") / (F.col("ext") + F.col("own") + 1), F.lit(1.0)))


def arrow_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Methods and functions that hold control flow nested four deep or more.

    Depths of DEEPEST and more have the same confidence and count as DEEPEST; a node is carried on only while its depth
    grows, so the loop ends on cycles and goes as far down as the code does."""
    kinds = nodes.select(F.col("id").alias("dst"), F.col("node_type").isin("IF", "ELIF", "FOREACH", "WHILE").cast("int").alias("deeper"))
    inside = edges.where("edge_type = 'CONTAINS'").select("src", "dst").distinct().join(kinds, "dst")
    found = frontier = cut(nodes.where("node_type in ('METHOD', 'FUNCTION')").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")))
    while not frontier.isEmpty():
        depth = F.least(F.col("depth") + F.col("deeper"), F.lit(DEEPEST))
        step = frontier.join(inside, frontier["id"] == inside["src"]).select("root", F.col("dst").alias("id"), depth.alias("depth")).groupBy("root", "id").agg(F.max("depth").alias("depth"))
        known = step.join(found.withColumnRenamed("depth", "known"), ["root", "id"], "left")
        frontier = cut(known.where("known is null or depth > known").select("root", "id", "depth"))
        found = cut(found.union(frontier).groupBy("root", "id").agg(F.max("depth").alias("depth")))
    deepest = found.groupBy(F.col("root").alias("id")).agg(F.max("depth").alias("d")).where("d >= 4")
    return _found(deepest, "ARROW_CODE", F.least(F.col("d") / DEEPEST, F.lit(1.0)))


def copy_paste(nodes: DataFrame) -> DataFrame:
    """Bodies that occur twice or more, by equality: every copy but the first is a finding."""
    some = nodes.where("body <> ''").select("id", F.sha2("body", 256).alias("key"))
    first = some.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return _found(some.join(first, "key").where("id <> first"), "COPY_PASTE", F.lit(1.0))


def alike_code(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, similarity): pairs of ``rows`` (idx, fp) whose projected vectors are at least ``least`` similar."""
    return similar_pairs(rows, least)


def tangled(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(id, degree): the evidence for SPAGHETTI, the k nodes with most calls in and out."""
    ends = edges.where("edge_type = 'CALLS'").select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def long_method(nodes: DataFrame) -> DataFrame:
    return _found(nodes.where("node_type in ('METHOD', 'FUNCTION') and line_count > 50"), "LONG_METHOD", F.least(F.col("line_count") / 100, F.lit(1.0)))


def long_parameter_list(nodes: DataFrame) -> DataFrame:
    return _found(nodes.where("node_type in ('METHOD', 'FUNCTION') and param_count > 5"), "LONG_PARAMETER_LIST", F.least(F.col("param_count") / 10, F.lit(1.0)))


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    called = edges.where("edge_type = 'CALLS'").select(F.col("dst").alias("id"))
    own = nodes.where(F.col("node_type").isin("METHOD", "FUNCTION") & ~F.col("name").isin(*ENTRY_NAMES))
    return _found(own.join(called, "id", "left_anti"), "DEAD_CODE", F.lit(0.8))


def analyze(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    parts = [god_object(nodes, edges), spaghetti(nodes, edges), circular(nodes, edges), feature_envy(nodes, edges), arrow_code(nodes, edges), copy_paste(nodes), long_method(nodes), long_parameter_list(nodes), dead_code(nodes, edges)]
    return reduce(DataFrame.unionByName, parts)


def node_smells(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(smell, id, confidence) of single nodes: classes with over 10 methods or under 2, methods of a cyclomatic number over 10 or with over 5
    uses, and any node whose members call each other over twice as often as there are members."""
    inner = edges.where("edge_type = 'CONTAINS'").select(F.col("src").alias("owner"), F.col("dst").alias("id")).distinct()
    methods = inner.join(nodes.where("node_type = 'METHOD'").select("id"), "id").groupBy(F.col("owner").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    classes = nodes.where("node_type = 'CLASS'").select("id").join(methods, "id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    own = nodes.where("node_type = 'METHOD'").select("id").join(cyclomatic(nodes, edges), "id")
    uses = nodes.where("node_type = 'METHOD'").select("id").join(edges.where("edge_type in ('CALLS', 'DEPENDS')").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("f")), "id")
    members = inner.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    side = lambda k: inner.select(F.col("id").alias(k), F.col("owner").alias(f"{k}_owner"))
    calls = edges.where("edge_type = 'CALLS'").join(side("src"), "src").join(side("dst"), "dst").where("src_owner = dst_owner").groupBy(F.col("src_owner").alias("owner")).agg(F.count(F.lit(1)).alias("c"))
    busy = members.join(calls, "owner").where("c > 2 * n").withColumnRenamed("owner", "id")
    parts = [
        _found(classes.where("m > 10"), "GOD_CLASS", F.least(F.col("m") / 20, F.lit(1.0))),
        _found(classes.where("m < 2"), "LAZY_CLASS", F.lit(0.8)),
        _found(own.where("cyclomatic > 10"), "LONG_METHOD", F.least(F.col("cyclomatic") / 20, F.lit(1.0))),
        _found(uses.where("f > 5"), "FEATURE_ENVY", F.least(F.col("f") / 10, F.lit(1.0))),
        _found(busy, "SPAGHETTI", F.least(F.col("c") / (F.col("n") * 5), F.lit(1.0))),
    ]
    return reduce(DataFrame.unionByName, parts)


def ranked(findings: DataFrame) -> DataFrame:
    """(smell, place, id, confidence): findings by kind, surest first, counted from 1."""
    order = Window.partitionBy("smell").orderBy(F.desc("confidence"), "id")
    return findings.withColumn("place", F.row_number().over(order)).select("smell", "place", "id", "confidence")


#: What a node smell of confidence over 0.5 calls for (fixed values).
REFACTORINGS = {"GOD_CLASS": "extract_class", "LONG_METHOD": "extract_method", "FEATURE_ENVY": "move_method", "LAZY_CLASS": "inline_class"}


def refactorings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, action, other): what node smells of confidence over 0.5 call for, and pairs coupled over 0.7, from both ends."""
    by_smell = F.element_at(F.create_map(*[F.lit(x) for kv in REFACTORINGS.items() for x in kv]), F.col("smell"))
    found = node_smells(nodes, edges).where("confidence > 0.5").select("id", by_smell.alias("action"), F.lit(None).cast(nodes.schema["id"].dataType).alias("other")).where("action is not null")
    close = coupled_pairs(nodes, edges).where("coupling > 0.7")
    return found.union(close.select("a", F.lit("reduce_coupling"), "b")).union(close.select("b", F.lit("reduce_coupling"), "a"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(smell, id, change): findings new since ``before``, and fixed."""
    keys = lambda df: df.select("smell", "id").distinct()
    new = keys(after).exceptAll(keys(before)).withColumn("change", F.lit("new"))
    return new.union(keys(before).exceptAll(keys(after)).withColumn("change", F.lit("fixed")))
