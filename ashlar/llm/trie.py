"""The trie of conversation prefixes: what conversations share from their first turn on, rolled up by pointer jumping.

A node is a sequence of first turns, keyed by a digest.  Edges lead from digest to digest; in rounds of doubling each node adds what it has
gathered to its ancestor 1, 2, 4, 8 ... levels up, so the number of rounds is the logarithm of the depth, not the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

#: Turns of a conversation that a window takes in one task; longer ones are numbered and summed in parts.
LONG = 65_536
#: Rows with one key that may go to a task of a join; keys with more meet the few targets they have by broadcast.
HOT = 10_000
#: At most so many keys can be hot: beyond HOT rows a key must hold this part of all rows.
HOT_KEYS = 50_000
#: Members' ids are joined in pieces of 2**PIECE_BITS neighbouring ids before they meet.
PIECE_BITS = 8

#: A turn's digest is cut into lanes of 32 bits, added up along a conversation; sums of whole numbers stay exact for 2**31 turns.
_LANES = [f"lane_{i}" for i in range(5)]


def turns(rows: DataFrame, long: int = LONG) -> DataFrame:
    """(conv_id, at, digest, chars): a row for each turn, ``at`` its place from 1 by turn (null first), role and text.

    Null roles and texts are empty.  Rows without a conversation are no turns.  Rows that tie in everything are alike, so their order is all one.
    """
    rows = rows.where("conv_id IS NOT NULL").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    large = C.written(rows.groupBy("conv_id").count().where(F.col("count") > long).select("conv_id"), "large")
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long"))
    if large.count():  # no more of them than rows / long
        few = F.broadcast(large)
        plain = rows.join(few, "conv_id", "left_anti")
        plain = plain.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long"))
        numbered = plain.unionByName(C.numbered(rows.join(few, "conv_id"), ["conv_id"], order, "at").withColumn("at", F.col("at") + 1))
    digest = F.sha2(F.concat_ws("/", F.length("role"), "role", "text"), 256)
    return numbered.select("conv_id", "at", digest.alias("digest"), F.length("text").cast("long").alias("chars"))


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *lanes)))


def paths(items: DataFrame, conversations: DataFrame, long: int = LONG) -> DataFrame:
    """(conv_id, depth, node, parent, chars, is_end): the nodes that each conversation passes, the root included, also by one without turns.

    A node's key digests the sum of its turns' digests.  As each of these digests the turn's place, too, the sum tells a sequence, and it is a plain
    running sum: a conversation of any length is added up in parts of ``long`` turns.
    """
    placed = F.sha2(F.concat_ws("/", "at", "digest"), 256)
    items = items.withColumn("digest", placed)
    lanes = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(_LANES)]
    items = items.select("conv_id", "at", *lanes, "chars")
    part = Window.partitionBy("conv_id", "part").orderBy("at")
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    items = items.withColumn("part", F.floor((F.col("at") - 1) / long).cast("long"))
    summed = items.withColumns({f"sum_{c}": F.sum(c).over(upto) for c in _LANES}).withColumn("is_end", F.lead("at").over(part).isNull())
    if (items.agg(F.max("at")).first()[0] or 0) > long:
        totals = items.groupBy("conv_id", "part").agg(*[F.sum(c).alias(f"before_{c}") for c in _LANES])
        earlier = Window.partitionBy("conv_id").orderBy("part")
        before = {f"before_{c}": F.coalesce(F.sum(f"before_{c}").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in _LANES}
        totals = totals.select("conv_id", "part", F.lead("part").over(earlier).isNull().alias("last_part"), *[x.alias(c) for c, x in before.items()])
        summed = summed.join(totals, ["conv_id", "part"])
        summed = summed.withColumns({f"sum_{c}": F.col(f"sum_{c}") + F.col(f"before_{c}") for c in _LANES} | {"is_end": F.col("is_end") & F.col("last_part")})
    sums = [F.col(f"sum_{c}") for c in _LANES]
    node, parent = _key(F.col("at"), sums), _key(F.col("at") - 1, [s - F.col(c) for s, c in zip(sums, _LANES, strict=True)])
    steps = summed.select("conv_id", F.col("at").alias("depth"), node.alias("node"), parent.alias("parent"), "chars", "is_end")
    zero = F.lit(0).cast("long")
    with_turns = items.where("at = 1").select("conv_id", F.lit(False).alias("is_end"))
    roots = conversations.join(with_turns, "conv_id", "left").select(
        "conv_id", zero.alias("depth"), _key(zero, [zero] * len(_LANES)).alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("chars"), F.coalesce("is_end", F.lit(True)).alias("is_end")
    )
    return steps.unionByName(roots)


def looked_up(rows: DataFrame, table: DataFrame, key: str, n_rows: int, weights: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows with the columns of ``table`` that has their ``key`` (one row a key); ``weights`` (key, n) says how many rows a key has.

    Keys of more than ``hot`` rows, and of more than the HOT_KEYS-th part of all, would overload a task: there are HOT_KEYS of them at most, whose rows of
    ``table`` are broadcast instead.
    """
    busy = weights.where(F.col("n") > max(hot, n_rows // HOT_KEYS)).select(key)
    if not busy.head(1):
        return rows.join(table, key)
    few = F.broadcast(busy)
    return rows.join(few, key, "left_anti").join(table, key).unionByName(rows.join(F.broadcast(table.join(few, key, "left_semi")), key))


def _digests(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order, joined by commas; a piece at a time, so a node may have any number of members."""
    node, state = None, None

    def told(node: bytes, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    for batch in stream:
        out = []
        for key, piece in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key == node:
                state.update(b"," + piece.encode())
                continue
            if node is not None:
                out.append((node, state.hexdigest()))
            node, state = key, hashlib.sha256(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield told(node, state)


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) for nodes at which conversations end: of their decimal ids, ascending, joined by commas.

    Ids are first joined in pieces of neighbours, bounded however many members a node has; SHA-256 itself takes them one after the other.
    """
    pieces = ends.groupBy("node", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_set("conv_id")).alias("ids"))
    pieces = pieces.select("node", "piece", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    dealt = pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids")
    return dealt.mapInArrow(_digests, "node binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, n_nodes: int, depth: int, hot: int = HOT) -> DataFrame:
    """(node, n_leaves, saved_tokens) summed over subtrees, from nodes (node, parent, depth, n_children, saved).

    After round k a node holds the sums over its descendants less than 2**k levels below and points to its ancestor 2**k levels up.  In the next round it
    takes what the nodes pointing to it hold, and those point on to where it points.  What points to a node is added up before the shuffle.
    """
    held = nodes.select("node", F.col("parent").alias("up"), "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    reach = 1
    while reach <= depth:
        given = held.where("up IS NOT NULL").groupBy("up").agg(F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below"), F.count(F.lit(1)).alias("n"))
        given = C.written(given, "given")
        below = given.select(F.col("up").alias("node"), "leaves_below", "saved_below")
        summed = held.join(below, "node", "left").select(
            "node", "up", "depth", *[(F.col(c) + F.coalesce(b, F.lit(0))).alias(c) for c, b in (("n_leaves", "leaves_below"), ("saved_tokens", "saved_below"))]
        )
        reach *= 2
        if reach <= depth:
            pointers = held.where("up IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("further"))
            on = looked_up(summed.where(F.col("depth") >= reach), pointers, "up", n_nodes, given.select("up", "n"), hot).select("node", F.col("further").alias("up"), "depth", "n_leaves", "saved_tokens")
            summed = on.unionByName(summed.where(F.col("depth") < reach).withColumn("up", F.lit(None).cast("binary")))
        held = C.written(summed, "held")
    return held.select("node", "n_leaves", "saved_tokens")


def prefix_trie(items: DataFrame, conversations: DataFrame, hot: int = HOT, long: int = LONG) -> DataFrame:
    """(node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each distinct prefix.

    ``items`` as of turns(), ``conversations`` (conv_id) all that take part, turns or not; without any there is no root either.  A conversation's id counts
    once however often it is listed.  ``saved_tokens`` adds up what sharing saves: of each node in the subtree the code points of its last text for
    every member but one.
    """
    conversations = conversations.where("conv_id IS NOT NULL").distinct()
    walked = C.written(paths(items, conversations, long), "paths")
    nodes = walked.groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    nodes = C.written(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    counted = nodes.join(children.select(F.col("parent").alias("node"), F.col("n").alias("n_children")), "node", "left")
    counted = C.written(counted.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "counted")
    n_nodes, depth = counted.agg(F.count(F.lit(1)), F.max("depth")).first()
    sums = rolled_up(counted, n_nodes, depth or 0, hot)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    weights = counted.where("n_children > 0").select(F.col("node").alias("parent"), F.col("n_children").alias("n"))
    named = looked_up(counted.where("parent IS NOT NULL"), parents, "parent", n_nodes, weights, hot)
    root = counted.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    ends = end_digests(walked.where("is_end").select("node", "conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    found = named.unionByName(root).join(sums, "node").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    return found.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(items: DataFrame, conversations: DataFrame, period: int = 100, most: int = 6) -> DataFrame:
    """Turns of conversations that begin as another does: conversation c takes the first h turns of conversation c - c % ``period`` (all it has, if
    fewer) and then its own after its first h, with h = crc32(decimal c) % ``most``.  Gaps that are left close up.
    """
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = items.where((F.col("at") < most) & (F.col("conv_id") % period == 0)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.max("at").alias("length"))
    plan = conversations.where("conv_id IS NOT NULL").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % period).alias("base"), share.alias("h"))
    plan = C.written(plan.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("length", F.lit(0)))), "plan")
    first = plan.join(heads, "base").where("at <= h")  # a base has at most ``period`` followers, and less than ``most`` turns here
    weights = items.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = looked_up(items, plan.select("conv_id", "h", "taken"), "conv_id", items.count(), weights)
    own = own.where("at > h").withColumn("at", F.col("at") - F.col("h") + F.col("taken"))
    return first.select(*items.columns).unionByName(own.select(*items.columns))
