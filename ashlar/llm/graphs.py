"""Connected components of a distributed edge list, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

MAX_ROUNDS = 60
#: A contracted graph of so many edges at most (counted first) is finished in one task.
LAST_EDGES = 16_384


def _united(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in stream:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is one of its nodes, the same for all.

    Each round every node points to the one of least hash among itself and its neighbours, and edges are redrawn between the nodes
    pointed to; those within a group vanish, so a star of any size is gone in one round and what is left shrinks by a
    constant factor a round on average, whatever the ids' order (the hash changes each round).  Once ``last_edges`` or fewer are
    left, one task unites them; at last the rounds' pointers are composed.
    Least neighbours are found with partial aggregation and edges meet one pointer per node, so a node with very
    many edges is no hot group.  Tables go to the shared folder; nothing but a row count reaches the driver.
    """
    rest = C.written(edges.where("a <> b").select("a", "b"), "edges")
    rounds: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        if rest.count() <= last_edges:
            rounds.append(C.written(rest.coalesce(1).mapInArrow(_united, "node long, label long"), "points"))
            break
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = rest.select(F.col("a").alias("node"), order("b").alias("to")).union(rest.select(F.col("b").alias("node"), order("a").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("to", order("node"))["n"].alias("label"))
        points = C.written(least, "points")
        rounds.append(points)
        redrawn = rest.join(points.toDF("a", "x"), "a").join(points.toDF("b", "y"), "b").where("x <> y")
        rest = C.written(redrawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    composed = rounds[0]
    for points in rounds[1:]:
        composed = composed.join(points.toDF("label", "further"), "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    composed = composed.withColumnRenamed("label", "component")
    return C.written(composed, "components") if len(rounds) > 1 else composed
