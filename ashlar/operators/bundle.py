"""Bundles of many vectors per group: majority and XOR.

Both states are mergeable.  XOR is bit_xor by word, with partial aggregation.  Majority counts in bit planes: plane k of a group holds bit k of
the number of its vectors that have each bit set, so n vectors take some log2(n) vectors instead of 10,000 numbers, and adding is a few operations on
words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bitvec as V
from .search import _present, matrix

#: Rows that a task adds up at once.
ROWS = 4096
#: Groups whose planes (1.3 kB times the logarithm of their vectors) a task holds before it sends them on.
GROUPS = 2048
#: A group's planes meet in so many places before they meet in one.
FIRST_MERGE = 64

_STATE = "k string, part int, n long, planes array<binary>"


def xor_reduce(rows: DataFrame, key: str, fp: str = "fp") -> DataFrame:
    """(key, fp): XOR of every group's vectors."""
    words = [F.bit_xor(F.col(fp)[i]).alias(f"w{i}") for i in range(V.WORDS)]
    return rows.groupBy(key).agg(*words).select(key, F.array(*[f"w{i}" for i in range(V.WORDS)]).alias(fp))


def planes_of(x: np.ndarray) -> list[np.ndarray]:
    """Bit planes of the column sums of rows of words: three rows become a sum and a carry, until each plane is one row."""
    planes, level = [], x
    while len(level):
        carries = []
        while len(level) > 1:
            third = len(level) // 3
            if third:
                a, b, c, rest = level[:third], level[third : 2 * third], level[2 * third : 3 * third], level[3 * third :]
                odd = a ^ b
                carries.append((a & b) | (c & odd))
                level = np.concatenate([odd ^ c, rest])
            else:  # two rows
                carries.append(level[:1] & level[1:])
                level = level[:1] ^ level[1:]
        planes.append(level[0])
        level = np.concatenate(carries) if carries else level[:0]
    return planes


def added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Planes of the sum: a ripple of carries over the planes."""
    out, carry = [], np.zeros(V.WORDS, dtype=np.uint64)
    zero = carry
    for k in range(max(len(a), len(b))):
        x, y = (p[k] if k < len(p) else zero for p in (a, b))
        odd = x ^ y
        out.append(odd ^ carry)
        carry = (x & y) | (carry & odd)
    return [*out, carry] if carry.any() else out


def over(planes: list[np.ndarray], n: int) -> np.ndarray:
    """Words whose bits tell where the number in the planes is more than ``n``: compared from the highest plane down."""
    more, equal = np.zeros(V.WORDS, dtype=np.uint64), np.full(V.WORDS, np.uint64(0xFFFFFFFFFFFFFFFF))
    if n >> len(planes):
        return more
    for k in range(len(planes) - 1, -1, -1):
        if n >> k & 1:
            equal = equal & planes[k]
        else:
            more = more | (equal & planes[k])
            equal = equal & ~planes[k]
    return more


def _told(held: dict[str | None, tuple[int, list[np.ndarray]]], part: int) -> pa.RecordBatch:
    keys = list(held)
    planes = pa.array([[p.tobytes() for p in held[k][1]] for k in keys], pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([part] * len(keys), pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()), planes], names=["k", "part", "n", "planes"])


def _partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Planes of the groups of a task's rows."""
    part = TaskContext.get().partitionId() % FIRST_MERGE
    held: dict[str | None, tuple[int, list[np.ndarray]]] = {}
    for batch in stream:
        for at in range(0, batch.num_rows, ROWS):
            piece = _present(batch.slice(at, ROWS), 1)
            if not piece.num_rows:
                continue
            coded = piece.column("k").dictionary_encode(null_encoding="encode")
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            order = np.argsort(codes, kind="stable")
            x = matrix(piece.column("v"))[order]
            edges = np.append(np.flatnonzero(np.diff(codes[order], prepend=-1)), len(order))
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                name = names[codes[order[first]]]
                n, planes = held.get(name, (0, []))
                held[name] = (n + int(last - first), added(planes, planes_of(x[first:last])))
            if len(held) > GROUPS:
                yield _told(held, part)
                held = {}
    if held:
        yield _told(held, part)


def _merged(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows of a group (and part); a row at a time is added to one state."""
    at, held = None, None
    for batch in stream:
        for k, part, n, planes in zip(*(batch.column(c).to_pylist() for c in ("k", "part", "n", "planes")), strict=True):
            own = [np.frombuffer(p, dtype=np.uint64) for p in planes]
            if held is not None and at == (k, part):
                held = (held[0] + n, added(held[1], own))
                continue
            if held is not None:
                yield _told({at[0]: held}, at[1])
            at, held = (k, part), (n, own)
    if held is not None:
        yield _told({at[0]: held}, at[1])


def _majority(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        words = [over([np.frombuffer(p, dtype=np.uint64) for p in planes], n // 2).view(np.int64) for n, planes in zip(batch.column("n").to_pylist(), batch.column("planes").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("n"), pa.array(words, pa.list_(pa.int64()))], names=["k", "n", "v"])


def majority(rows: DataFrame, key: str, fp: str = "fp") -> DataFrame:
    """(key, fp, n): a bit is set if more than half of the group's vectors have it; ties give 0.

    Each task adds up its own rows; a group's planes then meet first in FIRST_MERGE places by task and last in one, row by row with one state in memory, so a
    group that all tasks share is no more work for its last task than FIRST_MERGE additions.
    """
    kind = dict(rows.dtypes)[key]
    shipped = rows.select(F.col(key).cast("string").alias("k"), F.col(fp).alias("v"))
    partial = shipped.mapInArrow(_partial, _STATE).repartition("k", "part").sortWithinPartitions("k", "part").mapInArrow(_merged, _STATE)
    whole = partial.withColumn("part", F.lit(0)).repartition("k").sortWithinPartitions("k").mapInArrow(_merged, _STATE)
    merged = whole.mapInArrow(_majority, "k string, n long, v array<long>")
    return merged.select(F.col("k").cast(kind).alias(key), F.col("v").alias(fp), "n")
