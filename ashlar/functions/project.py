"""Vectors made in bulk, an Arrow batch at a time: seeded fingerprints, random-hyperplane projection, binarization at medians, state vectors.

Projection keeps similarity.  Its matrix follows from a seed, so every worker makes its own once (40 MB) and nothing is shipped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .bitvec import BITS, BYTES, LAST_MASK, WORDS

#: Fixed values of the projection.
SEED, DIMENSIONS = 42, 1024
#: Rows that are projected at a time: 50 kB each, whatever the size of the Arrow batch.
PROJECTED_ROWS = 512


@lru_cache(maxsize=1)
def matrix(dimensions: int = DIMENSIONS) -> np.ndarray:
    """One hyperplane per bit, from Gaussian numbers in the order the seed gives them."""
    return np.random.RandomState(SEED).randn(BITS, dimensions).astype(np.float32) / np.float32(np.sqrt(dimensions))


@F.pandas_udf(BinaryType())
def _projected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        out = np.full(len(values), None, dtype=object)
        lengths = np.array([-1 if v is None else len(v) for v in values])
        for n in np.unique(lengths[lengths > 0]):
            own = np.flatnonzero(lengths == n)
            for at in range(0, len(own), PROJECTED_ROWS):
                part = own[at : at + PROJECTED_ROWS]
                x = np.stack([np.asarray(values.iloc[i], dtype=np.float32) for i in part])
                for i, bits in zip(part, np.packbits(x @ matrix(int(n)).T > 0, axis=1), strict=True):
                    out[i] = bits.tobytes()
        yield pd.Series(out)


def fp_project(embedding: Column) -> Column:
    """1250 bytes: bit i tells on which side of hyperplane i the embedding lies, each byte's highest bit first; null or empty gives null."""
    return _projected(embedding.cast("array<float>"))


_PLACES = [f":{i}".encode() for i in range(WORDS)]


@F.arrow_udf(ArrayType(LongType(), False))
def _seeded(texts: pa.Array) -> pa.Array:
    digest, parts = hashlib.sha256, []
    for text in texts.to_pylist():
        if text is not None:
            head = text.encode()
            parts += [digest(head + place).digest()[:8] for place in _PLACES]
    words = np.frombuffer(b"".join(parts), dtype="<i8").copy()
    words[WORDS - 1 :: WORDS] &= LAST_MASK
    present = np.asarray(texts.is_valid()).astype(bool)
    ends = np.concatenate([[0], np.cumsum(present * WORDS)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(words), mask=pa.array(~present) if not present.all() else None)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew if it lies in fewer partitions than there are cores, as one small file does: for maps that cost far more than a shuffle of their input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def seeded(df: DataFrame, text: str, fp: str = "fp") -> DataFrame:
    """``df`` with the seeded fingerprints of a text column: fp_seed in bulk, about five times as fast; null gives null."""
    return spread(df).withColumn(fp, _seeded(F.col(text)))


#: Bits of a number that one turn of selection settles: a task counts 2**DIGIT values a dimension, and so many more each turn.
DIGIT = 13


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order (0.0 and -0.0 are one; NaN comes last)."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & (2**64 - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def order_statistics(df: DataFrame, embedding: str, ranks) -> dict[int, list[float]]:
    """For each dimension of an array column the values of given ranks, exactly: ``ranks(n)`` names them (from 0) for a dimension of n values.

    Numbers are settled from their highest bits down, DIGIT bits a turn, all dimensions and ranks at once.  In a turn each task counts the next digit of
    the values that share the digits settled so far; counts are added up, and the digit that holds the rank is settled.  A task holds 2**DIGIT counters for a
    dimension and rank, whatever the number of rows; what reaches the driver is one row a dimension and rank.  Null values do not count, NaN is the largest.
    """
    values = df.select(F.col(embedding).cast("array<double>").alias("x")).where("x IS NOT NULL")
    sizes = values.select(F.posexplode("x").alias("d", "v")).where("v IS NOT NULL").groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = {(r["d"], k): (0, rank) for r in sizes for k, rank in enumerate(ranks(r["n"]))}  # (digits settled, rank among those that share them)
    done = 0
    while done < 64 and wanted:
        width = min(DIGIT, 64 - done)
        shared = df.sparkSession.sparkContext.broadcast({t: v[0] for t, v in wanted.items()})

        def counted(stream: Iterator[pa.RecordBatch], shared=shared, done=done, width=width) -> Iterator[pa.RecordBatch]:
            counts: dict[tuple[int, int], np.ndarray] = {}
            by_dimension: dict[int, dict[int, list[int]]] = {}  # ranks that share a prefix are counted once
            for (d, k), prefix in shared.value.items():
                by_dimension.setdefault(d, {}).setdefault(prefix, []).append(k)
            for batch in stream:
                lists = batch.column("x")
                lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
                flat = lists.flatten()
                dims = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                valid = np.asarray(flat.is_valid()).astype(bool)
                keys = _ordered(np.asarray(flat.fill_null(0.0).to_numpy(zero_copy_only=False), dtype=np.float64))
                for d, prefixes in by_dimension.items():
                    own = keys[(dims == d) & valid]
                    for prefix, ks in prefixes.items():
                        mine = own if not done else own[own >> np.uint64(64 - done) == np.uint64(prefix)]
                        digit = (mine >> np.uint64(64 - done - width)) & np.uint64((1 << width) - 1)
                        counts[d, ks[0]] = counts.get((d, ks[0]), 0) + np.bincount(digit.astype(np.int64), minlength=1 << width)
            for (d, k), c in counts.items():
                some = np.flatnonzero(c)
                for kk in by_dimension[d][shared.value[d, k]]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), d, np.int32)), pa.array(np.full(len(some), kk, np.int32)), pa.array(some.astype(np.int32)), pa.array(c[some].astype(np.int64))], names=["d", "k", "digit", "n"])

        added = values.mapInArrow(counted, "d int, k int, digit int, n long").groupBy("d", "k", "digit").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("d", "k").orderBy("digit")
        asked = df.sparkSession.createDataFrame([(d, k, rank) for (d, k), (_, rank) in wanted.items()], "d int, k int, rank long")
        running = added.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(asked), ["d", "k"]).where("upto > rank")
        held = running.groupBy("d", "k").agg(F.min(F.struct("digit", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))).alias("s"))
        for r in held.select("d", "k", "s.digit", "s.rank").collect():
            prefix, _ = wanted[r["d"], r["k"]]
            wanted[r["d"], r["k"]] = ((prefix << width) | r["digit"], r["rank"])
        done += width
    found: dict[int, list[float]] = {}
    for (d, _), (key, _) in sorted(wanted.items()):
        found.setdefault(d, []).append(_value(key))
    return found


def binarized(df: DataFrame, embedding: str, bits: str = "bits") -> DataFrame:
    """``df`` with an array of booleans that tells in which dimensions an embedding lies over that dimension's median (of all rows; the mean of the two middle values, found exactly)."""
    middle = order_statistics(df, embedding, lambda n: [(n - 1) // 2, n // 2])
    medians = F.array(*[F.lit((a + b) / 2) for _, (a, b) in sorted(middle.items())]) if middle else F.array().cast("array<double>")
    return df.withColumn(bits, F.zip_with(embedding, medians, lambda x, m: x > m))


#: Bits of a state vector's parts, counted from each byte's highest: time, signal, quality (fixed values).
REGIONS = {"tau": (0, 3334), "sigma": (3334, 6667), "qualia": (6667, 10_000)}


@lru_cache(maxsize=1)
def _bases() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of the Gaussian bases of time and signal, and the noise that stands for no quality; each from a seed of its own."""
    (a, b), (c, d), (e, f) = REGIONS.values()
    return np.random.RandomState(SEED).randn(b - a) > 0, np.random.RandomState(SEED + 1).randn(d - c) > 0, np.random.RandomState(SEED + 2).randint(0, 2, f - e, dtype=np.uint8).astype(bool)


@F.arrow_udf(BinaryType())
def encode_state(tau: pa.Array, sigma: pa.Array, qualia: pa.Array) -> pa.Array:
    """1250 bytes of (tau, sigma, qualia): the bases' signs, or their opposites below zero and nothing at zero, and a hash of the quality's text."""
    time, signal, noise = _bases()
    out = []
    for t, s, q in zip(tau.to_pylist(), sigma.to_pylist(), qualia.to_pylist(), strict=True):
        of = lambda base, x: base if (x or 0) > 0 else ~base if (x or 0) < 0 else np.zeros(len(base), dtype=bool)
        quality = np.unpackbits(np.frombuffer(hashlib.sha256(q.encode()).digest() * 14, dtype=np.uint8))[: len(noise)] if q else noise
        out.append(np.packbits(np.concatenate([of(time, t), of(signal, s), quality]).astype(np.uint8)).tobytes())
    return pa.array(out, pa.binary())


def _correlation(own: np.ndarray, base: np.ndarray) -> float | None:
    """Of bits, from their counts, so that equal and opposite bits give just 1 and -1; None without variation."""
    n, x, y, both = len(base), int(np.count_nonzero(own)), int(np.count_nonzero(base)), int(np.count_nonzero(base[own != 0]))
    varied = x * (n - x) * y * (n - y)
    return (n * both - x * y) / math.sqrt(varied) if varied else None


@F.arrow_udf(StructType([StructField("tau", DoubleType()), StructField("sigma", DoubleType())]))
def decode_state(vector: pa.Array) -> pa.Array:
    """tau and sigma of state vectors, as correlations with the bases (sigma moved to 0..1); a part without variation gives null."""
    time, signal, _ = _bases()
    (a, b), (c, d), _ = REGIONS.values()
    rows = []
    for v in vector.to_pylist():
        bits = np.unpackbits(np.frombuffer(v if v is not None else bytes(BYTES), dtype=np.uint8))
        s = _correlation(bits[c:d], signal)
        rows.append({"tau": _correlation(bits[a:b], time), "sigma": None if s is None else max(0.0, min(1.0, (s + 1) / 2))})
    return pa.array(rows, pa.struct([("tau", pa.float64()), ("sigma", pa.float64())]))


def _tiled(text: str) -> np.ndarray:
    return np.frombuffer((hashlib.sha256(text.encode()).digest() * 40)[:BYTES], dtype=np.uint8)


@F.arrow_udf(BinaryType())
def capture_state(state: pa.Array, profile: pa.Array, trace: pa.Array) -> pa.Array:
    """1250 bytes of a moment: the majority of its state vector (encode_state), its activation profile and its trace of steps.

    The profile (a map of layer to activation) counts as text ``layer:0.00`` joined by ``|`` in the map's order, the trace as its first 20 steps joined by arrows;
    each stands for itself by its hash, tiled.  A null or empty profile is an empty text, a null or empty trace no bit at all; a null state gives null.
    """
    out = []
    for base, layers, steps in zip(state.to_pylist(), profile.to_pylist(), trace.to_pylist(), strict=True):
        if base is None:
            out.append(None)
            continue
        a, b = np.frombuffer(base, dtype=np.uint8), _tiled("|".join(f"{k}:{v:.2f}" for k, v in layers or []))
        c = _tiled("\u2192".join(steps[:20])) if steps else np.zeros(BYTES, dtype=np.uint8)
        out.append(((a & b) | (a & c) | (b & c)).tobytes())
    return pa.array(out, pa.binary())
