"""Exact search and exact similarity join of 10,000-bit vectors without comparing everything with everything.

Search: of C + 1 groups of bits, two vectors that differ in at most r bits differ in at most ``FLIPS`` bits in one group at least, if (C + 1) x
(FLIPS + 1) is more than r.  Each row is filed under the values of its groups; a query looks up the values within FLIPS bits of its own.

Join: rows go to the cell of their nearest pivot; a row visits the cell of another pivot only if the triangle inequality leaves room there for a
partner.  Where a sample of rows shows that this spares little, every two blocks of rows meet in a task instead, as compact codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bitvec as V
from .graph import cut
from .search import _present, matrix, query_words

#: Bits by which a query's groups are varied: 2 makes some 436 values a group of 29 bits.
FLIPS = 2
#: Ids of candidates up to so many become a filter of the scan, which skips pages; more are joined.
LISTED = 10_000
#: Entries of the index in one folder, about; folders are skipped by the first bits of a group's value.
FOLDER_ENTRIES = 4_000_000
#: Words of a vector that are looked at first: the distance in them bounds the whole from below.
COARSE_WORDS = 36
#: Rows of a cell, about; pivots are so many that cells are of this size, but at most PIVOTS.
CELL_ROWS = 2_048
PIVOTS = 512
#: Rows that tell whether cells spare work, and the share of the cells below its own that a row visits at most if they do.
PROBES, CROWDED = 512, 0.5
#: Rows of a block where every two blocks meet, at most; smaller tables make up to SPREAD blocks of SMALL_BLOCK rows or more, so that all cores have work.
BLOCK_ROWS, SPREAD, SMALL_BLOCK = 16_384, 16, 1_024
#: Pairs that a comparison hands on at a time, about: however many are near, it holds no more.
BATCH_PAIRS = 65_536
#: Copies of a vector that meet as one row, about, where every copy is paired; in very large tables more, so that fewer than LARGE vectors have more copies and travel with the tasks.
COPIES, LARGE = 256, 50_000


def _reach(threshold: float) -> int:
    return int(np.floor((1 - threshold) * V.BITS + 1e-6))


def groups_for(most: int) -> tuple[int, int]:
    """(groups, bits of a group) that find every pair within ``most`` bits."""
    n = most // (FLIPS + 1) + 1
    return n, min(56, V.BITS // n)


def group_values(x: np.ndarray, most: int) -> np.ndarray:
    """For rows of words the value of each group, the group's first bit lowest."""
    n, size = groups_for(most)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little")[:, : n * size]
    return bits.reshape(len(x), n, size) @ (1 << np.arange(size, dtype=np.int64))


def near_values(words: np.ndarray, most: int) -> np.ndarray:
    """(groups, variants): a vector's values within FLIPS bits, of each group."""
    _, size = groups_for(most)
    flips = [sum(1 << i for i in c) for k in range(FLIPS + 1) for c in combinations(range(size), k)]
    return group_values(words[None, :], most)[0][:, None] ^ np.array(flips, dtype=np.int64)


def _split(value: np.ndarray, size: int, first_bits: int) -> np.ndarray:
    return value >> (size - first_bits)


class HammingIndex:
    """Vectors and their groups' values as tables under one folder; ``search`` reads what may be near, and no more."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.n, self.most, self.first_bits, self.blocks = about["n"], about["most"], about["first_bits"], about["blocks"]

    @classmethod
    def build(cls, rows: DataFrame, path: str, threshold: float = 0.9, fp: str = "fp", idx: str = "idx", folder_entries: int = FOLDER_ENTRIES, groups: bool = True) -> HammingIndex:
        """Write the index of rows (idx, vector; rows that lack either take no part) for searches at ``threshold`` or more.

        Vectors are written in the order of idx in small pages, values by group and first bits: the more rows, the more folders.
        Without ``groups`` no values are filed, which are most of the work: such an index can ``scan`` but not ``search``.
        """
        spark, path, most = rows.sparkSession, path.rstrip("/"), _reach(threshold)
        n_groups, size = groups_for(most)
        # vectors are written once as they come: both the condition and the sample for the ranges would make them again
        own = cut(rows.select(F.col(idx).cast("long").alias("idx"), F.col(fp).alias("v"))).where("idx IS NOT NULL AND v IS NOT NULL")
        coarse = F.slice("v", 1, COARSE_WORDS).alias("coarse")
        own.select("idx", coarse, "v").repartitionByRange("idx").sortWithinPartitions("idx").write.option("parquet.page.size", "65536").option("parquet.enable.dictionary", "false").mode("overwrite").parquet(f"{path}/vectors")
        vectors = spark.read.parquet(f"{path}/vectors")
        n = vectors.count()
        # the number of folders a group's entries fill
        first_bits = int(min(12, max(0, np.ceil(np.log2(max(1, n / folder_entries))))))

        def filed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    values = group_values(matrix(part.column("v")), most)
                    group = np.tile(np.arange(n_groups, dtype=np.int32), len(values))
                    flat = values.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group), pa.array(_split(flat, size, first_bits).astype(np.int32)), pa.array(flat), pa.array(np.repeat(part.column("idx").to_numpy(), n_groups))], names=["grp", "first", "value", "idx"]
                    )

        blocks = int(min(n_groups, max(1, np.ceil(n_groups * n / folder_entries)))) if groups else 0
        if groups:
            entries = vectors.select("idx", "v").mapInArrow(filed, "grp int, first int, value long, idx long")
            folder = F.concat_ws("-", F.floor(F.col("grp") * blocks / n_groups).cast("int"), "first").alias("folder")
            dealt = entries.select(folder, "grp", "value", "idx").repartition("folder").sortWithinPartitions("folder", "grp", "value")
            dealt.write.partitionBy("folder").mode("overwrite").parquet(f"{path}/values")
        spark.createDataFrame([(n, most, first_bits, blocks)], "n long, most int, first_bits int, blocks int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return cls(spark, path)

    def candidates(self, query, threshold: float = 0.9) -> DataFrame:
        """(idx) of the rows that agree with the query within FLIPS bits in one group at least: all that may be near, and by chance few others."""
        most = _reach(threshold)
        if most > self.most:
            raise ValueError(f"the index was built for distances up to {self.most}")
        if not self.blocks:
            raise ValueError("the index was built without groups: it can be scanned only")
        words = query if isinstance(query, np.ndarray) else query_words(self.spark.range(1), query)
        n_groups, size = groups_for(self.most)
        near = near_values(words, self.most)
        probes = pd.DataFrame({"grp": np.repeat(np.arange(n_groups, dtype=np.int32), near.shape[1]), "value": near.ravel()})
        values = self.spark.read.parquet(f"{self.path}/values")
        if self.first_bits:  # folders that no probe can be in are not listed
            block = probes["grp"].to_numpy() * self.blocks // n_groups
            wanted = sorted({f"{b}-{f}" for b, f in zip(block, _split(probes["value"].to_numpy(), size, self.first_bits), strict=True)})
            values = values.where(F.col("folder").isin(wanted))
        return values.join(F.broadcast(self.spark.createDataFrame(probes)), ["grp", "value"]).select("idx").distinct()

    def search(self, query, threshold: float = 0.9) -> tuple[DataFrame, float]:
        """((idx, distance) of every row at least ``threshold`` similar, nearest first; the share of all vectors that were read in full)."""
        most = _reach(threshold)
        words = query_words(self.spark.range(1), query)
        found = cut(self.candidates(words, threshold))
        n = found.count()
        vectors = self.spark.read.parquet(f"{self.path}/vectors").select("idx", "v")
        rows = vectors.where(F.col("idx").isin([r["idx"] for r in found.collect()])) if n <= LISTED else vectors.join(found, "idx")
        return distances_within(rows, words, most).orderBy("distance", "idx"), n / max(1, self.n)

    def scan(self, query, threshold: float = 0.9) -> tuple[DataFrame, float]:
        """The same rows by resolution instead: the first words of all vectors, then the whole of those they do not rule out."""
        most = _reach(threshold)
        words = query_words(self.spark.range(1), query)
        head = self.spark.read.parquet(f"{self.path}/vectors").select("idx", "coarse")
        left = cut(distances_within(head.withColumnRenamed("coarse", "v"), words[:COARSE_WORDS], most).select("idx"))
        n = left.count()
        vectors = self.spark.read.parquet(f"{self.path}/vectors").select("idx", "v")
        rows = vectors.where(F.col("idx").isin([r["idx"] for r in left.collect()])) if n <= LISTED else vectors.join(left, "idx")
        return distances_within(rows, words, most).orderBy("distance", "idx"), n / max(1, self.n)


def distances_within(rows: DataFrame, words: np.ndarray, most: int) -> DataFrame:
    """(idx, distance) of rows (idx, v) within ``most`` bits of the query, over as many words as it has."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            batch = _present(batch, 1)
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, len(words))
            d = np.bitwise_count(x ^ words).sum(axis=1, dtype=np.int64)
            near = d <= most
            yield pa.RecordBatch.from_arrays([batch.column("idx").filter(pa.array(near)), pa.array(d[near])], names=["idx", "distance"])

    return rows.select("idx", "v").mapInArrow(run, "idx long, distance long")


def _bit_pairs(a: np.ndarray, b: np.ndarray, most: int, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of a, rows of b, distances) within ``most`` bits: the first words of all, the rest of what they leave.  ``same``: both sides are the same rows, each pair is wanted once."""
    for i in range(len(a)):
        first = i + 1 if same else 0
        head = np.bitwise_count(b[first:, :COARSE_WORDS] ^ a[i, :COARSE_WORDS]).sum(axis=1, dtype=np.int64)
        others = np.flatnonzero(head <= most)
        d = head[others] + np.bitwise_count(b[first + others, COARSE_WORDS:] ^ a[i, COARSE_WORDS:]).sum(axis=1, dtype=np.int64)
        yield i, first + others[d <= most], d[d <= most]


def _level_pairs(a: np.ndarray, b: np.ndarray, most: int, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for words with just low bits set, given as their number of bits, a byte a word: a distance is the sum of the differences.

    A row of a meets all of b at once, which lies word by word, one half of its rows in even places and one in odd.  As many differences as fit a byte
    are added up as bytes, then the sums of either half as 16 bits.
    """
    words, n = a.shape[1], len(b)
    together, half = min(words, 255 // max(1, int(a.max(initial=0)), int(b.max(initial=0)))), -(-n // 2)
    sums = -(-words // together)
    rows, columns = np.zeros((len(a), sums * together), np.int8), np.zeros((sums * together, 2 * half), np.int8)
    rows[:, :words], columns[:words, 0::2], columns[:words, 1 : 2 * (n - half) : 2] = a, b[:half].T, b[half:].T
    d = np.empty_like(columns)
    parts = d.view(np.uint8).reshape(together, sums, 2 * half)
    added = np.empty((sums, 2 * half), np.uint8)
    twos = added.view(np.uint16)
    wide, total = np.empty_like(twos), np.empty((2, half), np.uint16)
    for i in range(len(rows)):
        np.absolute(np.subtract(columns, rows[i][:, None], out=d), out=d)
        np.add.reduce(parts, axis=0, dtype=np.uint8, out=added)
        np.add.reduce(np.bitwise_and(twos, 255, out=wide), axis=0, dtype=np.uint16, out=total[0])
        np.add.reduce(np.right_shift(twos, 8, out=wide), axis=0, dtype=np.uint16, out=total[1])
        first = i + 1 if same else 0
        far = total.reshape(-1)[first:n]
        near = np.flatnonzero(far <= most)
        yield i, first + near, far[near]


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, the places where the ids of each row begin, and their end) of a column of ids or of arrays of ids."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(), np.arange(len(column) + 1)
    return pc.list_flatten(column).to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(), dtype=np.int64)])


def _members(found: Iterator[tuple[int, np.ndarray, np.ndarray]], a_at: np.ndarray, b_at: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of an id, places of others, distances) of the rows found: every id of one with every id of the other, and the ids of a row with each other."""
    sizes = np.diff(b_at)
    for i, others, d in found:
        n = sizes[others]
        places, far = np.repeat(b_at[others] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(d, n).astype(np.int64)
        for m in range(a_at[i], a_at[i + 1]):
            own = np.arange(m + 1, a_at[i + 1] if same else m + 1)
            q, e = np.concatenate([own, places]), np.concatenate([np.zeros(len(own), np.int64), far])
            for at in range(0, len(q), BATCH_PAIRS):
                yield m, q[at : at + BATCH_PAIRS], e[at : at + BATCH_PAIRS]


def _met(pairs, a: np.ndarray, b: np.ndarray, most: int, same: bool, a_rows: pa.ChunkedArray, b_rows: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """(a, b, distance), a < b, of all ids whose rows ``pairs`` finds near."""
    found, (a_ids, a_at), (b_ids, b_at) = pairs(a, b, most, same), _ids(a_rows), _ids(b_rows)
    if len(a_ids) > len(a) or len(b_ids) > len(b):
        found = _members(found, a_at, b_at, same)
    yield from _batches(found, a_ids, b_ids)


def _batches(found: Iterator[tuple[int, np.ndarray, np.ndarray]], a_ids: np.ndarray, b_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b, distance), a < b, of the pairs found, some BATCH_PAIRS at a time; rows with one id are no pair."""
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        rows, others, d = zip(*held, strict=True)
        p, q = np.repeat(a_ids[list(rows)], [len(o) for o in others]), b_ids[np.concatenate(others)]
        two = p != q
        return pa.RecordBatch.from_arrays([pa.array(x[two]) for x in (np.minimum(p, q), np.maximum(p, q), np.concatenate(d).astype(np.int64))], names=["a", "b", "distance"])

    for i, others, d in found:
        if len(others):
            held.append((i, others, d))
            n += len(others)
        if n >= BATCH_PAIRS:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def pivots_of(rows: DataFrame, n: int, cell_rows: int = CELL_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(up to PIVOTS rows, by a hash of their vectors: where rows are dense there are more of them, so cells stay of a size; up to PROBES rows besides)."""
    k = int(min(PIVOTS, max(1, np.ceil(n / cell_rows))))
    drawn = rows.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(k + PROBES).collect()
    x = np.array([r["v"] for r in drawn], dtype=np.int64).view(np.uint64).reshape(-1, V.WORDS)
    return x[:k], x[k:]


def _cells(x: np.ndarray, pivots: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell of the nearest pivot, whether each cell of lower number may hold a partner) of rows of words."""
    d = np.stack([np.bitwise_count(x ^ q).sum(axis=1, dtype=np.int64) for q in pivots], axis=1)
    home = d.argmin(axis=1)
    return home, (d - d[np.arange(len(x)), home][:, None] <= 2 * most) & (np.arange(len(pivots)) < home[:, None])


def crowded(pivots: np.ndarray, probes: np.ndarray, most: int) -> bool:
    """Whether rows visit so many of the cells below their own that comparing all pairs costs hardly more than cells, which send each row once a visit."""
    if not len(probes):
        return False
    home, visits = _cells(probes, pivots, most)
    return bool(visits.sum() > CROWDED * home.sum())


def placed(rows: DataFrame, pivots: np.ndarray, most: int) -> DataFrame:
    """(cell, home, idx, v): each row in the cell of its nearest pivot, and in those of lower number that may hold a partner within ``most`` bits.

    If x lies in cell i and b in cell j, d(b, x) >= (d(b, p_i) - d(b, p_j)) / 2; a pair over two cells is met in the lower one.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in stream:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column("v"))
                home, visits = _cells(x, p, most)
                row, cell = np.nonzero(visits)
                row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell])
                own = np.arange(len(row)) < len(x)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(own), *[c.take(pa.array(row)) for c in (part.column("idx"), part.column("v"))]], names=["cell", "home", "idx", "v"])

    return rows.select("idx", "v").mapInArrow(deal, f"cell int, home boolean, idx {_id_type(rows)}, v array<long>")


def _id_type(rows: DataFrame) -> str:
    return rows.schema["idx"].dataType.simpleString()


def all_pairs(rows: DataFrame, n: int, most: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """((a, b, distance), a < b, of all pairs of ``n`` rows (idx, v) within ``most`` bits, each once; the number of blocks, which is how often a row is sent).

    A row may stand for all rows with its vector: ``idx`` is then an array of their ids, which ``n`` counts, and every id is paired.
    Every two blocks of rows meet in a task.  Words behind the last one that any row uses are not sent, and words with just low bits set in all rows (see
    ``bitvec.thermometer``) go as a byte each.  A task holds two blocks and a batch of pairs.
    """

    def told(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = matrix(batch.column("v"))
            used = np.flatnonzero(x.any(axis=0)).max(initial=0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([not (x & (x + np.uint64(1))).any()]), pa.array([int(used)], pa.int32())], names=["levels", "words"])

    levels, words = rows.select("v").mapInArrow(told, "levels boolean, words int").agg(F.bool_and("levels"), F.max("words")).first()
    blocks = max(1, -(-n // block_rows), min(SPREAD, -(-n // SMALL_BLOCK)))

    def packed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = np.ascontiguousarray(matrix(batch.column("v"))[:, :words])
            code = np.bitwise_count(x) if levels else x.view(np.uint8)
            ends = np.arange(len(code) + 1, dtype=np.int32) * np.int32(code.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(ends), pa.py_buffer(code)])], names=["idx", "code"])

    def codes(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8 if levels else np.uint64).reshape(-1, words)

    def compare(key: tuple[pa.Scalar, ...], stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, both = key[0].as_py() == key[1].as_py(), pa.Table.from_batches(stream)
        one = both.filter(both["one"])
        two = one if same else both.filter(pc.invert(both["one"]))
        pairs = _level_pairs if levels else _bit_pairs
        yield from _met(pairs, codes(one["code"]), codes(two["code"]), most, same, one["idx"], two["idx"])

    own, other = F.col("block"), F.col("other")
    dealt = rows.select("idx", "v").mapInArrow(packed, f"idx {_id_type(rows)}, code binary").withColumn("block", F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), (own <= other).alias("one"), "idx", "code")
    # as many partitions as tasks: adaptive execution would put small ones together, but their work is the square of their size
    tasks = sent.repartition(min(4096, blocks * (blocks + 1) // 2), "x", "y")
    return tasks.groupBy("x", "y").applyInArrow(compare, "a long, b long, distance long"), blocks


def _copies_together(keyed: DataFrame, n: int) -> DataFrame:
    """(idx, v, part): of ``n`` rows (idx, v, key, row) those of one vector as one row with an array of their ids, or in several parts if there are many."""
    each = max(COPIES, -(-n // LARGE))
    large = keyed.groupBy("key").count().where(F.col("count") > each)
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.ceil(F.col("count") / each)), F.lit(0).cast("long")).alias("part")
    return keyed.join(F.broadcast(large), "key", "left").groupBy("key", part).agg(F.first("v").alias("v"), F.collect_list("idx").alias("idx")).select("idx", "v", "part")


def similarity_join(rows: DataFrame, threshold: float = 0.9, fp: str = "fp", idx: str = "idx", cell_rows: int = CELL_ROWS, every_copy: bool = False) -> tuple[DataFrame, float]:
    """((a, b, similarity), a < b, of all pairs of rows at least ``threshold`` similar, each once; how often a distinct vector was sent on average).

    Equal vectors meet as one row.  With ``every_copy`` each of its rows is in all pairs that it makes; without, the result is compact: pairs of the vectors' least
    rows, and a vector's own rows paired with its least row only.  A cell with more rows than ``cell_rows`` is compared block by block,
    each pair of blocks in a task of its own.  Rows without vector or id take no part.  Where no two pivots are far apart, as among random vectors and wide
    thresholds, rows would visit every cell below their own: then ``all_pairs`` compares them, in larger blocks that are sent less often.
    """
    most = _reach(threshold)
    own = rows.select(F.col(idx).cast("long").alias("idx"), F.col(fp).alias("v")).where("idx IS NOT NULL AND v IS NOT NULL")
    key = F.sha2(F.concat_ws(",", F.transform("v", lambda w: w.cast("string"))), 256)
    keyed = cut(own.withColumn("key", key).withColumn("row", F.monotonically_increasing_id()))
    if every_copy:
        n = keyed.count()
        reps = cut(_copies_together(keyed, n))
        distinct = reps.where("part = 0")  # so that a vector of many copies is a pivot once
        pivots, probes = pivots_of(distinct, distinct.count(), cell_rows)
    else:
        reps = cut(keyed.groupBy("key").agg(F.min_by("v", "idx").alias("v"), F.min("idx").alias("idx")).select("idx", "v", "key"))
        n = reps.count()
        pivots, probes = pivots_of(reps, n, cell_rows)
    found, copied = all_pairs(reps, n, most) if crowded(pivots, probes, most) else _by_cells(reps, n, pivots, most, cell_rows)
    near = found.select("a", "b", (1 - F.col("distance") / F.lit(float(V.BITS))).alias("similarity"))
    if every_copy:
        return near, float(copied)
    copies = keyed.select("key", F.col("idx").alias("b")).join(reps.select("key", F.col("idx").alias("a")), "key").where("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    return near.unionByName(copies), float(copied)


def _by_cells(reps: DataFrame, n: int, pivots: np.ndarray, most: int, cell_rows: int) -> tuple[DataFrame, float]:
    """((a, b, distance) of all pairs of ``n`` rows (idx, v) within ``most`` bits; how often a row was sent on average), cell by cell; ``idx`` as in ``all_pairs``."""
    dealt = cut(placed(reps, pivots, most)) if n else reps.select(F.lit(0).alias("cell"), F.lit(True).alias("home"), "idx", "v")
    ids = F.lit(1) if _id_type(reps) == "bigint" else F.size("idx")
    sizes = dealt.groupBy("cell", "home").agg(F.sum(ids).alias("count"))
    blocks = sizes.groupBy("cell").agg(*[F.ceil(F.sum(F.when(F.col("home") == h, F.col("count")).otherwise(0)) / cell_rows).cast("int").alias(x) for h, x in ((True, "own"), (False, "guests"))])
    sent = sizes.agg(F.sum("count")).first()[0] or 0
    block = lambda m: F.pmod(F.xxhash64("idx"), F.greatest(m, F.lit(1))).cast("int")
    known = dealt.join(F.broadcast(blocks), "cell")  # a row a pivot
    home = known.where("home").withColumn("x", block(F.col("own")))
    to = lambda begin, end: F.when(end > begin, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    # a task (cell, x, y, kind): own block x with own block y >= x, or own block x with guests' block y
    first = home.select("cell", "x", F.col("idx"), F.col("v"), F.explode(F.concat(F.transform(to(F.col("x"), F.col("own")), lambda y: F.struct(y.alias("y"), F.lit(0).alias("kind"))), F.transform(to(zero, F.col("guests")), lambda y: F.struct(y.alias("y"), F.lit(1).alias("kind"))))).alias("t"))
    first = first.select("cell", "x", "t.y", "t.kind", "idx", "v")
    second = home.select("cell", F.explode(to(zero, F.col("x") + 1)).alias("w"), F.col("x").alias("y"), F.lit(0).alias("kind"), "idx", "v").where("w < y").select("cell", F.col("w").alias("x"), "y", "kind", "idx", "v")
    guests = known.where("not home").withColumn("y", block(F.col("guests"))).select("cell", F.explode(to(zero, F.col("own"))).alias("x"), "y", F.lit(1).alias("kind"), "idx", "v")
    keys = ["cell", "x", "y", "kind"]

    def compare(key: tuple[pa.Scalar, ...], stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x, y, kind = (k.as_py() for k in key)
        same, both = kind == 0 and x == y, pa.Table.from_batches(stream)
        one = both.filter(both["one"])
        two = one if same else both.filter(pc.invert(both["one"]))
        yield from _met(_bit_pairs, matrix(one["v"]), matrix(two["v"]), most, same, one["idx"], two["idx"])

    tasks = first.withColumn("one", F.lit(True)).unionByName(second.unionByName(guests).withColumn("one", F.lit(False)))
    return tasks.groupBy(*keys).applyInArrow(compare, "a long, b long, distance long"), sent / max(1, n)
