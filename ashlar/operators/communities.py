"""Communities of a graph by modularity, level by level, and the smells that are read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .mining import frequent_itemsets

#: Turns of moves within a level and levels, at most; a level ends before when two turns move nothing.
MOST_TURNS, MOST_LEVELS = 20, 12
#: A gain must be larger than this, so that sums in another order move nothing.
LEAST_GAIN = 1e-9


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w) in both directions: one edge of weight 1 between two nodes however many there are; loops and missing ends drop out."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("w", F.lit(1.0))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _turn_of(node: Column) -> Column:
    """0 or 1: the turns in which a node may move, so that neighbours seldom change places at once."""
    return F.crc32(node.cast("string").cast("binary")) % 2


def _moved(links: DataFrame, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """(id, k, c) after a turn: each node whose turn it is goes to the community of a neighbour that gains most, of equal ones the least."""
    sums = labels.groupBy("c").agg(F.sum("k").alias("tot"))
    own = labels.select("id", "k", F.col("c").alias("own")).where(_turn_of(F.col("id")) == turn % 2)
    near = links.where("a <> b").join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
    choices = near.unionByName(own.select("id", F.col("own").alias("c"), F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))  # its own one, too
    scored = choices.join(own, "id").join(sums, "c")
    here = F.col("c") == F.col("own")
    scored = scored.withColumn("gain", F.col("w") - F.col("k") * (F.col("tot") - F.when(here, F.col("k")).otherwise(0.0)) / total)
    best = scored.groupBy("id").agg(F.min(F.struct((-F.round("gain", 9)).alias("g"), "c", "gain")).alias("best"), F.max(F.when(here, F.col("gain"))).alias("stay"))
    moves = best.where(F.col("best.gain") > F.col("stay") + LEAST_GAIN).select("id", F.col("best.c").alias("to"))
    return labels.join(moves, "id", "left").select("id", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved"))


def communities(edges: DataFrame, most_turns: int = MOST_TURNS, most_levels: int = MOST_LEVELS) -> DataFrame:
    """(id, community) of the nodes of ``edges`` (src, dst), taken as undirected; a community is named by its least node.

    Every node begins on its own.  In turns, half of the nodes at a time (by a checksum of their ids) move where modularity gains most.  When nothing
    moves the graph is contracted, a community becoming a node whose loop weighs what lies inside, and the next level begins; it ends when a level moves nothing.  A node
    of any degree meets one row a neighbour, added up by community before it is compared.
    """
    links = cut(undirected(edges))
    total = links.agg(F.sum("w")).first()[0]
    members = cut(links.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(most_levels if total else 0):
        labels = cut(links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")))
        still, ever = 0, False
        for turn in range(most_turns):
            after = cut(_moved(links, labels, total, turn))
            any_moved = not after.where("moved").isEmpty()
            labels, ever, still = after.drop("moved"), ever or any_moved, 0 if any_moved else still + 1
            if still == 2:
                break
        if not ever:
            break
        to = labels.select("id", "c")
        members = cut(members.join(to.withColumnRenamed("id", "community"), "community").select("id", F.col("c").alias("community")))
        ends = links.join(to.toDF("a", "ca"), "a").join(to.toDF("b", "cb"), "b")
        links = cut(ends.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    least = members.groupBy("community").agg(F.min("id").alias("least"))
    return members.join(least, "community").select("id", F.col("least").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, n_nodes, inside, share): of labels (id, community) the share of the graph's modularity that each community gives; the shares add up to it.

    ``inside`` counts the edges within a community.  Edges are undirected, each pair of nodes once."""
    links = undirected(edges)
    total = links.agg(F.sum("w").alias("total"))
    placed = links.join(labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    each = placed.groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("within"))
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"))
    share = F.col("within") / F.col("total") - (F.col("degree") / F.col("total")) ** 2
    found = sizes.join(each, "community", "left").crossJoin(F.broadcast(total))  # one row
    return found.select("community", "n_nodes", (F.coalesce("within", F.lit(0.0)) / 2).cast("long").alias("inside"), F.coalesce(share, F.lit(0.0)).alias("share"))


def big_ball_of_mud(nodes: DataFrame, edges: DataFrame, least_nodes: int = 10, most: float = 0.3) -> DataFrame:
    """(smell, id, confidence): one finding for the whole call graph (id null) if it has ``least_nodes`` connected nodes and its communities give a modularity under ``most``."""
    calls = edges.where("edge_type = 'CALLS'").select("src", "dst")
    each = modularity(calls, communities(calls))
    whole = each.agg(F.sum("share").alias("q"), F.sum("n_nodes").alias("n")).where((F.col("n") >= least_nodes) & (F.col("q") < most))
    return whole.select(F.lit("BIG_BALL_OF_MUD").alias("smell"), F.lit(None).cast(nodes.schema["id"].dataType).alias("id"), F.least(F.lit(1.0), 1 - F.col("q")).alias("confidence"))


def data_clumps(methods: DataFrame, least: int = 3, sizes: tuple[int, int] = (3, 5)) -> DataFrame:
    """(items, n): groups of parameter names that ``least`` methods or more take together, methods (id, parameters); of nested groups as frequent the largest."""
    found = cut(frequent_itemsets(methods.select(F.col("parameters").alias("items")).where("items IS NOT NULL"), least, sizes))
    # a group is left out if one more name is taken by as many methods
    less = found.select("n", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("items")).distinct()
    return found.join(less, ["items", "n"], "left_anti")
