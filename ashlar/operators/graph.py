"""Graph operators over ``edges`` (src, dst) and ``nodes`` (id).

Iterative ones expand one hop a turn from a driver loop over joins; every turn keeps a frontier, not all paths, and writes
it with checkpoint() where a turn depends on many before it.  Hot nodes meet one row per node on the other side.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: Hops that reach() takes in one plan, and rows of a graph that one task may settle.
ONE_PLAN, LAST_ROWS = 10, 50_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; in a local session one is made where none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="ashlar-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def degrees(nodes: DataFrame, edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(id, fan_out, fan_in); with ``distinct`` parallel edges count once."""
    links = edges.select("src", "dst").distinct() if distinct else edges
    out = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    joined = nodes.select("id").join(out, "id", "left").join(into, "id", "left")
    return joined.select("id", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def reach(starts: DataFrame, edges: DataFrame, hops: int | None = None, backwards: bool = False) -> DataFrame:
    """(start, id, hops): nodes reachable from each start (``starts``: id) and the fewest hops, the start itself at 0.

    Without ``hops`` until nothing new is found.  Up to ``ONE_PLAN`` hops are one plan and one job: every node also leads to itself at no cost, so what
    was found goes along, and each hop adds one join and one aggregation by start and node (paths do not multiply).
    """
    links = edges.select(F.col("dst").alias("at"), F.col("src").alias("to")) if backwards else edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    links = links.where("at IS NOT NULL AND to IS NOT NULL").distinct()
    seen = starts.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("hops")).distinct()
    if hops is not None and hops <= ONE_PLAN:
        stay = links.select("at").union(links.select("to")).union(starts.select("id")).distinct().select("at", F.col("at").alias("to"), F.lit(0).alias("cost"))
        moves = links.where("at <> to").withColumn("cost", F.lit(1)).union(stay)
        for _ in range(hops):
            step = seen.withColumnRenamed("id", "at").join(moves, "at")
            seen = step.groupBy("start", F.col("to").alias("id")).agg(F.min(F.col("hops") + F.col("cost")).alias("hops"))
        return seen
    frontier, turn = seen, 0
    while hops is None or turn < hops:
        turn += 1
        step = frontier.join(links, frontier["id"] == links["at"]).select("start", F.col("to").alias("id"), F.lit(turn).alias("hops")).distinct()
        frontier = cut(step.join(seen.select("start", "id"), ["start", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen


def reached(starts: DataFrame, edges: DataFrame, backwards: bool = False) -> DataFrame:
    """(id): all nodes that any start (``starts``: id) reaches, the starts too, each once.  A frontier of new nodes goes on each turn."""
    links = edges.select(F.col("dst").alias("at"), F.col("src").alias("to")) if backwards else edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    links = cut(links.distinct())
    seen = frontier = cut(starts.select("id").distinct())
    while True:
        step = frontier.join(links, frontier["id"] == links["at"]).select(F.col("to").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.union(frontier))


def upstream(starts: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """Distinct predecessors within ``hops`` (held to 1..10)."""
    found = reach(starts, edges, max(1, min(10, hops)), backwards=True)
    return found.where("hops > 0")


def path_to_terminal(starts: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """(start, path): a shortest path to a node without outgoing edges, of equal ones the least; none if there is none.

    The frontier holds one path per start and node, so paths do not multiply.
    """
    links = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    frontier = starts.select(F.col("id").alias("start"), "id", F.array("id").alias("path")).distinct()
    seen, found = frontier.select("start", "id"), None
    for _ in range(most):
        ended = frontier.join(links, frontier["id"] == links["at"], "left_anti").groupBy("start").agg(F.min("path").alias("path"))
        ended = ended if found is None else ended.join(found, "start", "left_anti")
        found = cut(ended if found is None else found.union(ended))
        going = frontier.join(found, "start", "left_anti")
        step = going.join(links, going["id"] == links["at"]).select("start", F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path"))
        frontier = cut(step.join(seen, ["start", "id"], "left_anti").groupBy("start", "id").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("start", "id"))
    return found


def _last_levels(level: int, stop: bool):
    """Levels of a small rest of a graph, rows (src, dst) with src null for a node, from ``level`` on, in one task."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(stream) if (stream := list(stream)) else None
        if rows is None or not rows.num_rows:
            return
        waits, leads, found = {}, {}, {}
        for src, dst in zip(rows["src"].to_pylist(), rows["dst"].to_pylist(), strict=True):
            if src is None:
                waits.setdefault(dst, 0)
        for src, dst in zip(rows["src"].to_pylist(), rows["dst"].to_pylist(), strict=True):
            if src is not None and dst in waits:
                waits[dst] += 1
                leads.setdefault(src, []).append(dst)
        order, at, now = sorted(waits), 0, level
        free = [x for x in order if not waits[x]]
        while len(found) < len(waits):
            if not free:
                if stop:
                    break
                while order[at] in found:
                    at += 1
                free = [order[at]]
            found |= dict.fromkeys(free, now)
            ahead = []
            for x in free:
                for y in leads.get(x, ()):
                    waits[y] -= 1
                    if not waits[y] and y not in found:
                        ahead.append(y)
            free, now = ahead, now + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), rows["dst"].type), pa.array(list(found.values()), pa.int32())], names=["id", "level"])

    return run


def levels(nodes: DataFrame, edges: DataFrame, on_cycle: str = "least", last_rows: int = LAST_ROWS) -> DataFrame:
    """(id, level): nodes whose predecessors are all at lower levels.  In a cycle the least id goes next (``least``), or the rest gets no level (``stop``).

    Level by level; once nodes and edges left are ``last_rows`` or fewer (counted), one task settles them."""
    left, links, done, level = cut(nodes.select("id").where("id IS NOT NULL").distinct()), edges.select("src", "dst").where("src <> dst").distinct(), None, 0
    kind = left.schema["id"].dataType
    while n := left.count():
        inner = links.join(left.select(F.col("id").alias("src")), "src", "left_semi")
        if n <= last_rows and n + (inner := cut(inner)).count() <= last_rows:
            rest = left.select(F.lit(None).cast(kind).alias("src"), F.col("id").alias("dst")).union(inner.select(F.col("src").cast(kind), F.col("dst").cast(kind)))
            last = rest.coalesce(1).mapInArrow(_last_levels(level, on_cycle == "stop"), T.StructType([T.StructField("id", kind), T.StructField("level", T.IntegerType())]))
            done = last if done is None else done.union(last)
            break
        free = left.join(inner.select(F.col("dst").alias("id")), "id", "left_anti")
        if free.isEmpty():
            if on_cycle == "stop":
                break
            free = left.agg(F.min("id").alias("id"))
        free = cut(free.withColumn("level", F.lit(level)))
        done = free if done is None else done.union(free)
        left, level = cut(left.join(free, "id", "left_anti")), level + 1
    return nodes.select("id").distinct().join(done, "id", "left") if done is not None else nodes.select("id", F.lit(None).cast("int").alias("level"))


def plan_for(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): what ``targets`` (id) need, themselves too, at the levels that the whole graph gives; edges lead from what is needed to what needs it.
    Levels without such nodes stay empty."""
    needed = reached(targets, edges, backwards=True)
    return levels(nodes, edges).join(needed, "id", "left_semi")


def stages(nodes: DataFrame, edges: DataFrame, phases: tuple[str, ...]) -> DataFrame:
    """(id, stage): execution stages of nodes (id, phase, parallelizable).

    In every round the nodes without predecessors left are ready; in a cycle those with fewest.  Ready nodes run phase by phase: those that may
    run together make one stage, the others one each, in the order of their ids."""
    left, links, parts, round_ = cut(nodes.select("id", "phase", "parallelizable")), cut(edges.select("src", "dst")), [], 0
    while not left.isEmpty():
        waiting = links.join(left.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        open_ = cut(left.join(waiting, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))))
        least = open_.agg(F.min("n")).first()[0]
        ready = open_.where(F.col("n") == least).select("id", "phase", "parallelizable", F.lit(round_).alias("round"))
        parts.append(cut(ready))
        left, round_ = cut(left.join(parts[-1], "id", "left_anti")), round_ + 1
    done = reduce(DataFrame.union, parts) if parts else left.withColumn("round", F.lit(0))
    place = F.array_position(F.array(*[F.lit(p) for p in phases]), F.col("phase")).cast("int")
    keyed = done.select("id", "round", place.alias("place"), (~F.col("parallelizable")).cast("int").alias("alone"), F.when(~F.col("parallelizable"), F.col("id")).alias("own"))
    order = ["round", "place", "alone", "own"]
    groups = keyed.select(*order).distinct()
    # stages are numbered per round by a window and rounds by their sizes, so no window spans the graph
    inside = groups.withColumn("k", F.row_number().over(Window.partitionBy("round").orderBy(F.col("place"), F.col("alone"), F.col("own").asc_nulls_first())))
    sizes = inside.groupBy("round").agg(F.max("k").alias("size"))
    before = sizes.select("round", "size").alias("a").join(sizes.select(F.col("round").alias("earlier"), F.col("size").alias("s")), F.col("earlier") < F.col("round"), "left").groupBy("round").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("before"))  # a row per round
    numbered = inside.join(F.broadcast(before), "round").select(*[F.col(c).alias(f"g_{c}") for c in order], (F.col("before") + F.col("k") - 1).cast("int").alias("stage"))
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"g_{c}")), order, F.lit(True))
    return keyed.join(numbered, same).select("id", "stage")


def data_flow_fields(edges: DataFrame) -> DataFrame:
    """(id, fields): sorted fields that flow into a node, of edges (dst, kind, field)."""
    flow = edges.where("kind = 'data_flow' and field is not null")
    return flow.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("field")).alias("fields"))


def _between(links: DataFrame, left: DataFrame) -> DataFrame:
    return links.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi")


def _coloured(links: DataFrame) -> DataFrame:
    """(id, colour): of those that reach a node, the one of least hash (a pair of hash and id).  Only nodes whose colour changed send it on.

    By hashes, so that no order of ids makes many turns of it: of a graph without edges between colours about half the pairs of nodes come apart a turn."""
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    found = cut(ends.select("id", F.struct(F.xxhash64("id").alias("hash"), F.col("id").alias("root")).alias("colour")))
    moving = found
    while True:
        offered = moving.join(links, moving["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("offered"))
        moving = cut(offered.join(found, "id").where("offered < colour").select("id", F.col("offered").alias("colour")))
        if moving.isEmpty():
            return found
        found = cut(found.join(moving.withColumnRenamed("colour", "new"), "id", "left").select("id", F.coalesce("new", "colour").alias("colour")))


#: Rounds of contraction go on while one leaves at most this share of the edges.
SHRUNK = 0.9


def _contracted(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges that are left, (id, before, after) of the nodes taken out): one round.

    Nodes without a way in or out are components of their own and go.  A node with one way in, or one way out, is taken out, and whatever led to it leads on
    to where it led: that adds no edges and changes nothing in what the other nodes reach.  Of neighbours that could go the one of less hash goes."""
    ends = links.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(links.select("dst", F.lit(0), F.lit(1)))
    few = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o < 2 or i < 2").select("id", ((F.col("o") > 0) & (F.col("i") > 0)).alias("light"))
    side = lambda rows, k: rows.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in rows.columns[1:]])
    told = cut(links.join(side(few, "src"), "src", "left").join(side(few, "dst"), "dst", "left").where("coalesce(src_light, true) and coalesce(dst_light, true)"))
    rank = lambda k: F.struct(F.xxhash64(k), F.col(k))
    staying = told.where("src_light and dst_light").select(F.when(rank("src") < rank("dst"), F.col("dst")).otherwise(F.col("src")).alias("id")).distinct().withColumn("stays", F.lit(True))
    told = told.join(side(staying, "src"), "src", "left").join(side(staying, "dst"), "dst", "left")
    told = cut(told.select("src", "dst", *[(F.col(f"{k}_light").isNotNull() & F.col(f"{k}_stays").isNull()).alias(f"{k}_goes") for k in ("src", "dst")]))
    into, out = told.where("dst_goes").select(F.col("dst").alias("id"), F.col("src").alias("before")), told.where("src_goes").select(F.col("src").alias("id"), F.col("dst").alias("after"))
    gone = cut(into.join(out, "id"))
    kept = told.where("not src_goes and not dst_goes").select("src", "dst").union(gone.where("before <> after").select("before", "after"))
    return cut(kept.distinct()), gone


#: A graph of so many edges at most (counted first), or what is left of a larger one, is finished in one task, as arrays of numbers (under 200 MB).
LAST_EDGES = 524_288


def _knotted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of the nodes of one partition's edges: depth-first search forwards, then backwards from the last finished."""
    batches = list(stream)
    if not sum(b.num_rows for b in batches):
        return
    coded = pa.chunked_array([b.column(k) for k in (0, 1) for b in batches]).dictionary_encode().combine_chunks()
    ids, ends = coded.dictionary, coded.indices.to_numpy().reshape(2, -1)
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(len(ids), np.int64)  # nodes are numbered in the order of their ids
    rank[order] = np.arange(len(ids))
    src, dst = rank[ends]
    n = len(ids)

    def ways(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).tolist(), b[np.argsort(a, kind="stable")].tolist()

    at, to = ways(src, dst)
    next_way, seen, finished = at[:-1], bytearray(n), []
    for root in range(n):
        stack = [] if seen[root] else [root]
        seen[root] = 1
        while stack:
            node = stack[-1]
            way, end = next_way[node], at[node + 1]
            while way < end and seen[to[way]]:
                way += 1
            next_way[node] = way + 1
            if way < end:
                seen[to[way]] = 1
                stack.append(to[way])
            else:
                finished.append(node)
                stack.pop()
    at, to = ways(dst, src)
    component = [-1] * n
    for root in reversed(finished):
        if component[root] < 0:
            members, component[root] = [root], root
            for node in members:
                for x in to[at[node] : at[node + 1]]:
                    if component[x] < 0:
                        component[x] = root
                        members.append(x)
            least = min(members)
            for node in members:
                component[node] = least
    sorted_ids = ids.take(pa.array(order))
    yield pa.RecordBatch.from_arrays([sorted_ids, sorted_ids.take(pa.array(component))], names=["id", "component"])


def strong_components(nodes: DataFrame, edges: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """(id, component): the least id of those that a node reaches and is reached by.

    First nodes with one way in or out are taken out of the graph, round by round, which halves long ways; then what is left is coloured: every node takes
    the colour of a node that reaches it, the nodes of a colour that reach its root make up the root's component, and edges between colours go.  This is repeated until
    ``last_edges`` or fewer are left.  Nodes taken out come back last first: such a node belongs to its neighbours' component if one before and one after it have the same.
    A turn keeps one row per node or edge, never pairs of them."""
    everything = nodes.select("id").distinct()
    kind = T.StructType([T.StructField(c, everything.schema["id"].dataType) for c in ("id", "component")])
    links = cut(_between(edges.select("src", "dst").where("src <> dst").distinct(), everything))
    n, parts, taken = links.count(), [], []
    while n > last_edges:
        while True:
            before = n
            links, gone = _contracted(links)
            taken.append(gone)
            n = links.count()
            if n <= last_edges or n > SHRUNK * before:
                break
        if n <= last_edges:
            break
        colours = _coloured(links)
        side = lambda k: colours.select(F.col("id").alias(k), F.col("colour").alias(f"{k}_colour"))  # noqa: E731, B023
        inside = cut(links.join(side("src"), "src").join(side("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"))
        found = reached(colours.where("id = colour.root"), inside, backwards=True)
        parts.append(cut(found.join(colours, "id").select("id", F.col("colour.root").alias("component"))))
        links = cut(inside.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"))
        n = links.count()
    if n:
        parts.append(links.coalesce(1).mapInArrow(_knotted, kind))
    known = reduce(DataFrame.union, parts) if parts else everything.limit(0).select("id", F.col("id").alias("component"))
    own = lambda k: known.select(F.col("id").alias(k), F.col("component").alias(f"{k}_part"))
    for gone in reversed(taken):
        known = cut(known)
        placed = gone.join(own("before"), "before", "left").join(own("after"), "after", "left").select("id", F.coalesce("before_part", "before").alias("component"), F.coalesce("after_part", "after").alias("other"))
        known = known.union(placed.where("component = other").select("id", "component").distinct())
    known = cut(known) if taken else known
    least = known.groupBy("component").agg(F.least(F.min("id"), F.col("component")).alias("least"))
    named = known.union(known.select("component", "component")).distinct().join(least, "component").select("id", "least")
    return everything.join(named, "id", "left").select("id", F.coalesce("least", "id").alias("component"))


def cycles(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(cycle, length): simple cycles of up to ``most`` nodes, each once, from its least id on; a loop at a node is a cycle of one.

    Only strong components of more than one node are searched, and paths go to larger ids than their start's alone.  The number of
    simple cycles may grow exponentially with ``most``."""
    loops = edges.where("src = dst").select(F.array("src").alias("cycle")).distinct()
    parts = strong_components(nodes, edges)
    large = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    inside = parts.join(large, "component", "left_semi")
    side = lambda k: inside.select(F.col("id").alias(k), F.col("component").alias(f"{k}_component"))
    links = cut(edges.select("src", "dst").where("src <> dst").distinct().join(side("src"), "src").join(side("dst"), "dst").where("src_component = dst_component").select("src", "dst"))
    paths, found = links.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path")), [loops]
    for length in range(2, most + 1):
        paths = cut(paths)
        if paths.isEmpty():
            break
        found.append(paths.join(links, (paths["at"] == links["src"]) & (paths["start"] == links["dst"])).select(F.col("path").alias("cycle")))
        if length < most:
            step = paths.join(links, paths["at"] == links["src"]).where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst")))
            paths = step.select("start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
    return reduce(DataFrame.union, found).select("cycle", F.size("cycle").alias("length"))


def shortest_paths(starts: DataFrame, ends: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """(start, end, path): all shortest paths from each start (id) to each end (id)."""
    hops = cut(reach(starts, edges, most))
    # an edge lies on a shortest path from a start if it leads one hop further
    on = edges.select("src", "dst").distinct().join(hops.select("start", F.col("id").alias("src"), F.col("hops").alias("h")), "src").join(hops.select("start", F.col("id").alias("dst"), F.col("hops").alias("next")), ["start", "dst"]).where("next = h + 1")
    on = cut(on.select("start", "src", "dst"))
    wanted = hops.join(ends.select("id").distinct(), "id", "left_semi")
    moving = wanted.select("start", F.col("id").alias("end"), F.col("id").alias("at"), F.array("id").alias("path"))
    found = []
    while True:
        moving = cut(moving)
        if moving.isEmpty():
            break
        found.append(moving.where("at = start").select("start", "end", "path"))
        moving = moving.where("at <> start").join(on.withColumnRenamed("dst", "at"), ["start", "at"]).select("start", "end", F.col("src").alias("at"), F.concat(F.array("src"), "path").alias("path"))
    return reduce(DataFrame.union, found) if found else moving.select("start", "end", "path")


def live_nodes(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Nodes reachable from roots: ids given, or nodes without incoming edges and, where ``nodes`` has a node_type, triggers."""
    if roots is None:
        roots = nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id")
        if "node_type" in nodes.columns:
            roots = roots.union(nodes.where("node_type = 'TRIGGER'").select("id"))
    return nodes.join(reached(roots, edges), "id", "left_semi")


def fusible_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges along which two pure nodes of one executor can be run as one: the only way out of one and into the other."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("src")
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("dst")
    side = lambda k: nodes.where("pure").select(F.col("id").alias(k), F.col("executor").alias(f"{k}_executor"))
    pairs = edges.select("src", "dst").where("src <> dst").join(out, "src", "left_semi").join(into, "dst", "left_semi")
    return pairs.join(side("src"), "src").join(side("dst"), "dst").where("src_executor = dst_executor").select("src", "dst")


def fuse(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, head): chains of fusible edges contracted to their first node, by pointer doubling."""
    parent = fusible_edges(nodes, edges).select(F.col("dst").alias("id"), F.col("src").alias("head"))
    while True:
        parent = cut(parent)
        further = parent.select(F.col("id").alias("head"), F.col("head").alias("next"))
        jumped = parent.join(further, "head", "left").select("id", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("moved"))
        if jumped.where("moved and id <> head").isEmpty():
            break
        parent = jumped.where("id <> head").select("id", "head")
    return nodes.select("id").join(parent, "id", "left").select("id", F.coalesce("head", "id").alias("head"))


def parallel_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, predecessors, n): pure nodes with the same set of predecessors, two or more; such nodes can run together.

    A set is known by its size and two sums of hashes, which add up partially, so neither a hub's successors nor a group's members meet in one row;
    ``predecessors`` is the hash."""
    links = edges.select("src", "dst").distinct()
    hashed = lambda seed: F.sum(F.xxhash64("src", F.lit(seed)).cast("decimal(38,0)"))
    sets = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("k"), hashed(1).alias("x"), hashed(2).alias("y"))
    sets = sets.select("id", F.sha2(F.concat_ws(":", "k", "x", "y"), 256).alias("predecessors"))
    own = sets.join(nodes.select("id", "pure"), "id")
    groups = own.groupBy("predecessors").agg(F.count(F.lit(1)).alias("n"), F.bool_and("pure").alias("all_pure")).where("n > 1 and all_pure")
    return own.join(groups, "predecessors").select("id", "predecessors", "n")


def cacheable(nodes: DataFrame) -> DataFrame:
    """Pure nodes of kinds whose results can be kept."""
    return nodes.where("pure and node_type in ('VALIDATE', 'TRANSFORM', 'QUERY')")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, id): edges to unknown nodes, isolated nodes, nodes in cycles; no entry or no terminal with id null."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    orphan = ends.join(nodes, "id", "left_anti").select(F.lit("orphan_edge").alias("problem"), "id")
    alone = nodes.join(ends, "id", "left_anti").select(F.lit("isolated").alias("problem"), "id")
    parts = cut(strong_components(nodes, edges))
    large = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    cyclic = parts.join(large, "component", "left_semi").select("id").union(loops.join(nodes, "id", "left_semi").select("id")).distinct()
    none = lambda rows, what: rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(what).alias("problem"), F.lit(None).cast(nodes.schema["id"].dataType).alias("id"))
    entry = none(nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti"), "no_entry")
    terminal = none(nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti"), "no_terminal")
    return orphan.union(alone).union(cyclic.select(F.lit("cycle").alias("problem"), "id")).union(entry).union(terminal)


def composed(nodes: DataFrame, edges: DataFrame, base: str, name: str, removals: list[str] | None = None, additions: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a new graph: those of ``base`` (ids that begin with it and one more character), less ``removals`` (ids), and with the rows of
    ``additions`` (frames of nodes, as a search finds them) under ids that begin with ``name``.  Edges need both ends; run validate() on the result."""
    own = nodes.where(F.col("id").like(f"{base}_%"))
    links = edges.where(F.col("src").like(f"{base}_%") | F.col("dst").like(f"{base}_%"))
    if removals:
        own = own.where(~F.col("id").isin(*removals))
    links = _between(links, own)
    for found in additions or []:
        own = own.unionByName(found.select(*[F.concat(F.lit(f"{name}_"), "id").alias("id") if c == "id" else F.col(c) for c in nodes.columns]))
    return own, links.select(*edges.columns)


def cohesion(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, cohesion) of ``groups`` (key, id): inner edges over n(n-1); 1 for fewer than two nodes."""
    members = groups.select("key", "id").distinct()
    inner = edges.join(members.select("key", F.col("id").alias("src")), "src").join(members.select(F.col("key").alias("k2"), F.col("id").alias("dst")), "dst").where("key = k2")
    counted = inner.groupBy("key").agg(F.count(F.lit(1)).alias("inner"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    score = F.when(F.col("n") < 2, 1.0).otherwise(F.coalesce("inner", F.lit(0)) / (F.col("n") * (F.col("n") - 1)))
    return sizes.join(counted, "key", "left").select("key", score.alias("cohesion"))


def containment(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """(id, depth, path): depth below the root and names from it, by each node's least parent.

    With one parent each, nodes are met once and those on a cycle never, so the loop ends by itself at any depth."""
    parent = contains.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    roots = nodes.join(parent, "id", "left_anti").select("id", F.lit(0).alias("depth"), F.array(F.col("name")).alias("names"))
    found = frontier = cut(roots)
    for depth in count(1):
        step = parent.join(frontier.select(F.col("id").alias("parent"), "names"), "parent").join(nodes.select("id", "name"), "id")
        frontier = cut(step.select("id", F.lit(depth).alias("depth"), F.concat("names", F.array("name")).alias("names")))
        if frontier.isEmpty():
            break
        found = found.union(frontier) if depth % 50 else cut(found.union(frontier))  # short plans
    return found.select("id", "depth", F.array_join("names", " → ").alias("path"))
