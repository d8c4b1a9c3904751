"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a table of a ring.

One more shard takes rows only into itself: of n shards' rows about one in n + 1 moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

SHARDS = 40
#: Bytes a row takes besides its text.
ROW_BYTES = 16
#: Fixed values of the published function (Lamping and Veach 2014): multiplier of its generator, bits of a draw.
MULTIPLIER = 2862933555777941757
DRAW_BITS = 31

_LOW_32 = 0xFFFFFFFF
_LOW_16 = 0xFFFF


def _times(high: Column, low: Column, times: int, plus: int) -> tuple[Column, Column]:
    """key * times + plus modulo 2**64 on halves of 32 bits and factors of 16, no product of which leaves a long (as ANSI mode asks)."""
    m = [(times >> bits) & _LOW_16 for bits in (0, 16, 32, 48)]
    middle = low * m[1]
    lower = low * m[0] + F.shiftleft(middle.bitwiseAND(_LOW_16), 16) + (plus & _LOW_32)
    upper = F.shiftright(lower, 32) + F.shiftright(middle, 16) + (plus >> 32)
    for half, by, above in ((low, m[2], m[3]), (high, m[0], m[1])):
        upper = upper + half * by + F.shiftleft((half * above).bitwiseAND(_LOW_16), 16)
    return upper.bitwiseAND(_LOW_32), lower.bitwiseAND(_LOW_32)


def _of(high: Column) -> Column:
    """The draw, 1 to 2**31, of a generator's state."""
    return F.shiftright(high, 1) + 1


def _draws(high: Column, low: Column, n: int) -> Column:
    """The first ``n`` draws of a key: its state after k turns is key * M**k + (M**(k-1) + ... + 1), with constants known beforehand."""
    draws, times, plus = [], 1, 0
    for _ in range(n):
        times, plus = times * MULTIPLIER % (1 << 64), (plus * MULTIPLIER + 1) % (1 << 64)
        draws.append(_of(_times(high, low, times, plus)[0]))
    return F.array(*draws)


def jump(key: Column, shards: int) -> Column:
    """struct<shard, grown>: the shard of a 64-bit key (null: as 0) among ``shards``, and among one more.

    A key jumps to ever later shards; the last jump below the number of shards is its place.  Jumps get longer as they go, so a key makes
    some ln(shards) of them: a few more draws are made for all, and as many as there can be jumps for the rare key that wants them.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    n = F.lit(shards).cast("long")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    high, low = F.shiftrightunsigned(key, 32), key.bitwiseAND(_LOW_32)
    none, first = F.lit(-1).cast("long"), F.lit(0).cast("long")

    def to(state: Column, draw: Column) -> Column:
        return F.floor((state["to"] + 1) * (F.lit(float(1 << DRAW_BITS)) / draw.cast("double"))).cast("long")

    def step(state: Column, draw: Column) -> Column:
        return F.when(state["to"] < n, F.struct(state["to"].alias("at"), to(state, draw).alias("to"))).otherwise(state)

    def slow_step(state: Column, _: Column) -> Column:
        up, down = _times(state["high"], state["low"], MULTIPLIER, 1)
        return F.when(state["to"] < n, F.struct(up.alias("high"), down.alias("low"), state["to"].alias("at"), to(state, _of(up)).alias("to"))).otherwise(state)

    def ended(state: Column) -> Column:
        return F.struct(state["at"].cast("int").alias("shard"), F.when(state["to"] == n, n).otherwise(state["at"]).cast("int").alias("grown"))

    some = F.aggregate(_draws(high, low, min(shards, 4 + 3 * math.ceil(math.log(shards + 1)))), F.struct(none.alias("at"), first.alias("to")), step)
    every = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.struct(high.alias("high"), low.alias("low"), none.alias("at"), first.alias("to")), slow_step)
    # bound once: transform() evaluates the first draws a single time for all that follows
    return F.transform(F.array(some), lambda state: F.when(state["to"] < n, ended(every)).otherwise(ended(state)))[0]


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, keep_text: bool = True) -> DataFrame:
    """The rows with size, text_crc32, law, shard, slot and grown_shard (the shard among one more), helper and result columns under free names.

    ``key`` is a whole number; hash others first.  Rows of one key share a shard, a null key counts as 0.  ``slot`` numbers a shard's rows
    without gaps by key (null first), size and checksum; rows that tie in these stand in any order.  A null text has no bytes and the
    checksum of none.  A shard is as large as it is: numbering sorts globally, so no shard and no repeated key is one task's.
    """
    size, crc, law, shard, slot, grown, both = C.free_names(docs.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "both")
    body = F.coalesce(C.keyed(text), F.lit("")).cast("binary")
    left = docs.withColumns({size: F.octet_length(body).cast("long") + ROW_BYTES, crc: F.crc32(body), both: jump(C.keyed(key), shards)})
    left = left if keep_text else left.drop(text)
    left = left.withColumns({law: F.lit("key"), shard: F.col(both)["shard"], grown: F.col(both)["grown"]}).drop(both)
    placed = C.numbered(left, [shard], [C.keyed(key).asc_nulls_first(), F.col(size), F.col(crc)], slot)
    names = [c for c in docs.columns if keep_text or c != text]
    return placed.select(*[C.keyed(c) for c in names], size, crc, law, shard, slot, grown)


def write(assigned: DataFrame, path: str, shard: str = "shard", slot: str = "slot", file_rows: int = 1_000_000) -> None:
    """A folder a shard, its rows in the order of their slots, in files of ``file_rows`` at most; a shard is written by as many tasks as it has files."""
    part = C.free_name(assigned.columns, "part")
    dealt = assigned.withColumn(part, F.floor(F.col(slot) / file_rows)).repartition(F.col(shard), F.col(part)).sortWithinPartitions(shard, slot)
    dealt.drop(part).write.partitionBy(shard).option("maxRecordsPerFile", file_rows).mode("overwrite").parquet(path)
