"""Message packets and their streams.

A header is 80 bytes, little-endian: source hash 32, target hash 32, ttl 1, priority 1, flags 2, sequence 4, CRC-32 of those
72 bytes 4, padding 4.  All of it is built from expressions, so the same code serves batch and streaming frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL, PRIORITY, TRACE_FLAG = 8, 5, 1


def node_hash(node: Column) -> Column:
    return F.unhex(F.sha2(node, 256))


def topic(node: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(node, 256), 1, digits)


def entry_node(entity: Column, operation: Column) -> Column:
    return F.concat(entity, F.lit("_"), operation, F.lit("_entry"))


def _little(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)]))


def _number(data: Column, at: int, size: int) -> Column:
    digits = F.hex(F.substring(data, at, size))
    return F.conv(F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(size, 0, -1)]), 16, 10).cast("long")


def pack(source: Column, target: Column, ttl: Column, priority: Column, flags: Column, sequence: Column) -> Column:
    body = F.concat(source, target, _little(ttl, 1), _little(priority, 1), _little(flags, 2), _little(sequence, 4))
    return F.concat(body, _little(F.crc32(body), 4), _little(F.lit(0), 4))


def unpack(header: Column) -> Column:
    """Struct of the fields and ``error``: null, ``short`` or ``checksum``."""
    body = F.substring(header, 1, 72)
    error = F.when(F.octet_length(header) < 80, "short").when(F.crc32(body) != _number(header, 73, 4), "checksum")
    fields = {"ttl": (65, 1), "priority": (66, 1), "flags": (67, 2), "sequence": (69, 4)}
    return F.struct(F.substring(header, 1, 32).alias("source"), F.substring(header, 33, 32).alias("target"), *[_number(header, *at).cast("int").alias(k) for k, at in fields.items()], error.alias("error"))


def hopped(packets: DataFrame, here: Column, to: Column) -> DataFrame:
    """Packets (ttl, sequence, trace, target) sent on; those without ttl left carry error ``ttl expired`` and stay."""
    alive = F.col("ttl") > 0
    return packets.select(
        *[c for c in packets.columns if c not in ("ttl", "sequence", "trace", "target", "error")],
        F.when(alive, F.col("ttl") - 1).otherwise(F.col("ttl")).alias("ttl"),
        F.when(alive, F.col("sequence") + 1).otherwise(F.col("sequence")).alias("sequence"),
        F.when(alive, F.concat("trace", F.array(here))).otherwise(F.col("trace")).alias("trace"),
        F.when(alive, to).otherwise(F.col("target")).alias("target"),
        F.when(~alive, F.lit("ttl expired")).alias("error"),
    )


def routed(packets: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One hop for packets at their target: (sent on along every edge, ended at nodes without edges, expired)."""
    links = edges.select(F.col("src").alias("__at"), F.col("dst").alias("__to")).distinct()
    going = packets.join(links, packets["target"] == links["__at"])
    sent = hopped(going, F.col("__at"), F.col("__to")).drop("__at", "__to")
    ended = packets.join(links, packets["target"] == links["__at"], "left_anti")
    return sent.where("error is null"), ended, sent.where("error is not null")


def broadcast_targets(packets: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """Packets (with ``resonance``, 157 words) sent on to each of the k nodes (id, fp) nearest to it, one hop through the router; ttl spent gives an error."""
    from ..operators.search import knn_join

    keyed = packets.withColumn("packet", F.xxhash64(*[c for c in packets.columns if c != "resonance"]))
    ids = nodes.withColumn("node", F.xxhash64("id"))
    near = knn_join(keyed.select(F.col("packet").alias("query_id"), F.col("resonance").alias("fp")).dropDuplicates(["query_id"]), ids.select(F.col("node").alias("idx"), "fp"), k)
    named = near.join(ids.select(F.col("node").alias("idx"), F.col("id").alias("to")), "idx").select(F.col("query_id").alias("packet"), "to")
    return hopped(keyed.join(named, "packet"), F.lit("router"), F.col("to")).drop("packet", "to")


def executed(packets: DataFrame, nodes: DataFrame, executors: dict) -> DataFrame:
    """Packets (target, payload) with ``result``: what the executor of their target's fn_name makes of the payload (JSON text); packets for unknown nodes have none."""
    from ..plans.execute import BUILT_IN

    named = packets.join(nodes.select(F.col("id").alias("target"), "fn_name"), "target", "left")
    out = F.when(F.col("fn_name").isNull(), F.lit(None).cast("string"))
    for name, make in (BUILT_IN | executors).items():
        out = out.when(F.col("fn_name") == name, F.to_json(make({"payload": F.col("payload")})))
    nobody = F.to_json(F.struct(F.lit("no_executor").alias("status"), F.col("target").alias("node")))
    return named.withColumn("result", out.otherwise(nobody)).select(*packets.columns, "result")


def topics(rows: DataFrame, kind: str, key: Column) -> DataFrame:
    """Rows with ``topic``: execute, node, results or dead and a key, as one log for all of them."""
    return rows.withColumn("topic", F.concat(F.lit(f"{kind}:"), key))


def retained(rows: DataFrame, stream: str = "topic", order: str = "seq", most: int = 10_000) -> DataFrame:
    """The last ``most`` rows of every stream.  A sequence without gaps tells which they are from its end alone, by partial aggregation."""
    ends = rows.groupBy(stream).agg(F.max(order).alias("end"))
    return rows.join(ends, stream).where(F.col("end") - F.col(order) < most).select(*rows.columns)


def lengths(rows: DataFrame, stream: str = "topic", most: int = 10_000) -> DataFrame:
    """(stream, n, full): rows of every stream, and whether writers should wait."""
    return rows.groupBy(stream).agg(F.count(F.lit(1)).alias("n")).withColumn("full", F.col("n") >= most)


def after(rows: DataFrame, offsets: DataFrame, count: int = 10, stream: str = "topic", order: str = "seq") -> DataFrame:
    """The next ``count`` rows of every stream after its offset (stream, last); a stream without one is read from its beginning.  Sequences have no gaps."""
    begun = rows.join(offsets.select(stream, "last"), stream, "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    return begun.where((F.col(order) > F.col("last")) & (F.col(order) <= F.col("last") + count)).select(*rows.columns)


def once(stream: DataFrame, key: str = "id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream without packets seen before within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key, "sequence"])


#: Tasks a node type may use at once (fixed values); any other type gets one.
PARALLELISM = {"VALIDATE": 4, "TRANSFORM": 4, "PERSIST": 1, "TRIGGER": 2, "QUERY": 2}


def by_node_type(rows: DataFrame) -> DataFrame:
    """Rows with ``slot``, dealt to as many slots per node type as it may use at once."""
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PARALLELISM.items() for x in kv]), F.col("node_type")), F.lit(1))
    return rows.withColumn("slot", F.concat_ws(":", "node_type", F.pmod(F.xxhash64("id"), most))).repartition("slot")


def run_batch(packets: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, dead letters): hops until no packet moves; ttl bounds the turns.  Use it as a foreachBatch body."""
    from ..operators.graph import cut

    most = packets.agg(F.max("ttl")).first()[0] or 0
    results = packets.limit(0).withColumn("error", F.lit(None).cast("string"))
    dead = results
    moving = packets
    for _ in range(most + 1):
        sent, ended, expired = routed(moving, edges)
        results = results.unionByName(ended.withColumn("error", F.lit(None).cast("string")))
        dead = dead.unionByName(expired)
        moving = cut(sent.drop("error"))
        if moving.isEmpty():
            break
    return results, dead


def delivered(packets: DataFrame, edges: DataFrame) -> DataFrame:
    """Packets at every node without edges that their target reaches within their ttl, by fewest hops: ttl less and sequence more by the hops.

    Ways are followed once for each target, however many packets are on it."""
    from ..operators.graph import reach

    most = packets.agg(F.max("ttl")).first()[0] or 0
    ways = reach(packets.select(F.col("target").alias("id")), edges, most)
    ends = ways.join(edges.select(F.col("src").alias("id")), "id", "left_anti").select(F.col("start").alias("target"), F.col("id").alias("end"), "hops")
    rest = [c for c in packets.columns if c not in ("target", "ttl", "sequence")]
    return packets.join(ends, "target").where("hops <= ttl").select(*rest, F.col("end").alias("target"), (F.col("ttl") - F.col("hops")).alias("ttl"), (F.col("sequence") + F.col("hops")).alias("sequence"))


def worked(packets: DataFrame, edges: DataFrame, nodes: DataFrame, executors: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, dead letters, log) of packets with a payload: every node they reach runs its executor, whose result is the next payload.

    log: target, result, trace.  Packets for unknown nodes are dead letters."""
    from ..operators.graph import cut

    most = packets.agg(F.max("ttl")).first()[0] or 0
    none = packets.limit(0).withColumn("error", F.lit(None).cast("string"))
    results, dead, log, moving = none, none, None, packets
    for _ in range(most + 1):
        done = cut(executed(moving, nodes, executors))
        lost = done.where("result is null").select(*packets.columns, F.lit("unknown node").alias("error"))
        ran = done.where("result is not null").withColumn("payload", F.col("result"))
        step = ran.select("target", "result", "trace")
        log = step if log is None else log.union(step)
        sent, ended, expired = routed(ran.select(*packets.columns), edges)
        results = results.unionByName(ended.withColumn("error", F.lit(None).cast("string")))
        dead = dead.unionByName(lost).unionByName(expired)
        moving = cut(sent.drop("error"))
        if moving.isEmpty():
            break
    return results, dead, log


def worker(stream: DataFrame, edges: DataFrame, out: str, checkpoint: str, nodes: DataFrame | None = None, executors: dict | None = None):
    """A streaming query that runs each micro-batch's packets to their ends and appends results and dead letters under ``out``; with ``nodes``
    (id, fn_name) every node runs its executor on the payload, and the log is appended too."""

    def each(batch: DataFrame, batch_id: int) -> None:
        # a folder per batch: a batch that is run again after a failure replaces what it wrote before
        if nodes is None:
            parts = dict(zip(("results", "dead"), run_batch(batch, edges), strict=True))
        else:
            parts = dict(zip(("results", "dead", "log"), worked(batch, edges, nodes, executors or {}), strict=True))
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, node_id, n) of tumbling windows over (ts, node_id), late rows dropped after the watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "node_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "node_id", "n")
