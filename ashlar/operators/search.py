"""Search over bit-vectors: thresholds, nearest neighbours, two stages.

One query is a constant: a scan, an Arrow kernel that counts the bits that differ in a batch, and what passes (or the batch's
best k) goes on.  Distances are computed once per row, and only rows that may be in the result leave the task.  A small table of queries
(counted first) travels with the tasks; a larger one is matched in blocks against chunks of the corpus, and each pair of them sends
on k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import bitvec as V
from .graph import cut

#: A query table of so many rows at most (counted first, 1.3 kB each) travels with the tasks; larger ones are matched in blocks of as many.
QUERY_BLOCK = 4096
#: Rows of the corpus that meet a block of queries in one task, about.
CHUNK_ROWS = 65_536


def query_words(corpus: DataFrame, query: Column | str | list[int]) -> np.ndarray:
    """A query's words: of a text its seeded vector, of a constant column its value."""
    if isinstance(query, Column):
        query = corpus.sparkSession.range(1).select(query.alias("q")).first()["q"]
    words = V.seed_words(query) if isinstance(query, str) else list(query)
    return np.array(words, dtype=np.int64).view(np.uint64)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of words of an array<bigint> column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, V.WORDS)


def distances(corpus: DataFrame, query: Column | str | list[int], fp: str = "fp", most: int | None = None, k: int | None = None, idx: str = "idx") -> DataFrame:
    """``corpus`` with ``distance``: bits that differ from the query.  Of each batch only rows within ``most``, and of these
    the ``k`` nearest (ties by ``idx``), are kept, so a top k above it sorts few rows.  A row without vector drops out."""
    words = query_words(corpus, query)
    schema = T.StructType([*corpus.schema.fields, T.StructField("distance", T.LongType())])
    fp_at, idx_at = corpus.columns.index(fp), corpus.columns.index(idx) if k is not None else None

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            batch = _present(batch, fp_at)
            d = np.bitwise_count(matrix(batch.column(fp_at)) ^ words).sum(axis=1, dtype=np.int64)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(d)], names=schema.names)
            if most is not None:
                out = out.filter(pa.array(d <= most))
            if k is not None and out.num_rows > k:
                out = out.take(pc.sort_indices(pa.table({"d": out.column(len(schema) - 1), "i": out.column(idx_at)}), [("d", "ascending"), ("i", "ascending")])[:k])
            yield out

    return corpus.mapInArrow(run, schema)


def _present(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """Rows with a vector.  (A filter of the plan would be pushed below the vectors' making, which would then run twice.)"""
    return batch.filter(batch.column(at).is_valid()) if batch.column(at).null_count else batch


def _similar(found: DataFrame) -> DataFrame:
    return found.withColumn("similarity", 1 - F.col("distance") / F.lit(float(V.BITS))).drop("distance")


def resonate(corpus: DataFrame, query: Column | str | list[int], threshold: float = 0.6, k: int | None = None, fp: str = "fp", idx: str = "idx") -> DataFrame:
    """Rows at least ``threshold`` similar, most similar first, ties by ``idx``.

    Without ``k`` the rows found are checkpointed before they are sorted, as sorting looks at its input twice."""
    most = int(np.floor((1 - threshold) * V.BITS + 1e-6))
    found = distances(corpus, query, fp, most, k, idx)
    ordered = (found if k is not None else cut(found)).orderBy("distance", idx)
    return _similar(ordered.limit(k) if k is not None else ordered)


def resonate_item(corpus: DataFrame, by: str, value, threshold: float = 0.6, k: int | None = None, fp: str = "fp", idx: str = "idx") -> DataFrame:
    """resonate for the vector of the corpus' own row that has ``value`` in the column ``by`` (a name or an index); the least by ``idx`` if there are
    several, and no rows if there is none."""
    own = corpus.where(F.col(by) == value).orderBy(idx).select(fp).first()
    return _similar(corpus.limit(0).withColumn("distance", F.lit(0).cast("long"))) if own is None else resonate(corpus, own[0], threshold, k, fp, idx)


def find_similar(corpus: DataFrame, query: Column | str | list[int], k: int = 5, exclude=None, fp: str = "fp", idx: str = "idx") -> DataFrame:
    """The k most similar whatever their similarity, one row left out if ``exclude`` names it."""
    return resonate(corpus if exclude is None else corpus.where(F.col(idx) != exclude), query, 0.0, k, fp, idx)


def first_alike(corpus: DataFrame, query: Column | str | list[int], threshold: float = 0.9, fp: str = "fp", idx: str = "idx") -> DataFrame:
    """The row of least ``idx`` that is at least ``threshold`` similar, or none."""
    most = int(np.floor((1 - threshold) * V.BITS + 1e-6))
    return _similar(distances(corpus, query, fp, most).orderBy(idx).limit(1))


def knn(corpus: DataFrame, query: Column | str | list[int], k: int = 10, fp: str = "fp", idx: str = "idx") -> DataFrame:
    """The k rows at least Hamming distance, ties by ``idx``.  Put scalar conditions on ``corpus`` before."""
    return distances(corpus, query, fp, None, k, idx).orderBy("distance", idx).limit(k)


def two_stage(corpus: DataFrame, query: Column, most: int, k: int = 10, data: str = "fp_bytes", idx: str = "idx") -> DataFrame:
    """Rows within ``most`` bits, or all if there are none, best segment score first (1250-byte vectors)."""
    measured = distances(corpus.withColumn("words", V.from_bytes(F.col(data))), V.from_bytes(query), "words").drop("words")
    near = measured.where(F.col("distance") < most)
    near = measured if near.isEmpty() else near
    return near.withColumn("score", V.segment_score(F.col(data), query)).orderBy("score", idx).limit(k)


def clean_up(corpus: DataFrame, query: Column | str | list[int], least_zero_words: int = 0, fp: str = "fp", idx: str = "idx") -> DataFrame:
    """Associative memory: the nearest row that agrees with the query in ``least_zero_words`` words or more."""
    if least_zero_words:
        words = query_words(corpus, query).view(np.int64).tolist()
        corpus = corpus.where(V.zero_words(F.col(fp), V.literal(words)) >= least_zero_words)
    return knn(corpus, query, 1, fp, idx)


def pair_similarity(pairs: DataFrame, items: DataFrame, fp: str = "fp", idx: str = "idx") -> DataFrame:
    """(a, b, similarity) for ``pairs`` (a, b) of items; 0.0 where an item is missing."""
    side = lambda k: items.select(F.col(idx).alias(k), F.col(fp).alias(f"fp_{k}"))
    both = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.select("a", "b", F.coalesce(V.similarity(F.col("fp_a"), F.col("fp_b")), F.lit(0.0)).alias("similarity"))


def replayed(traces: DataFrame, query: Column | str | list[int], k: int = 5, most: int = 100, fp: str = "fp", idx: str = "idx") -> DataFrame:
    """Of the ``k`` nearest past traces (with a ``success`` column) those that went well and lie within ``most`` bits: their results can be reused."""
    return knn(traces, query, k, fp, idx).where(F.col("success") & (F.col("distance") < most))


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    out: tuple[list, list, list] = ([], [], [])
    for i in range(len(q) if len(x) else 0):
        d = np.bitwise_count(x ^ q[i]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
        near = near[np.lexsort((ids[near], d[near]))[:k]]
        out[0].append(np.full(len(near), q_ids[i]))
        out[1].append(ids[near])
        out[2].append(d[near])
    whole = lambda c: pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64))
    return pa.RecordBatch.from_arrays([whole(c) for c in out], names=["query_id", "idx", "distance"])


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, fp: str = "fp", query_id: str = "query_id", idx: str = "idx") -> DataFrame:
    """(query_id, idx, distance, rank): the k nearest corpus rows of every query, ties by idx.

    Up to ``QUERY_BLOCK`` queries travel with the tasks of one scan.  More are dealt into blocks of as many by a hash of their id, and
    the corpus into chunks of ``CHUNK_ROWS``; every block meets every chunk once, in a task of bounded size.  Rows without vector or id take no part.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(fp).alias("v")).where("q is not null")
    rows = corpus.select(F.col(idx).cast("long").alias("idx"), F.col(fp).alias("v")).where("idx is not null")
    n, schema = asked.count(), "query_id long, idx long, distance long"
    if n <= QUERY_BLOCK:
        own = [r for r in asked.collect() if r["v"] is not None]
        shipped = corpus.sparkSession.sparkContext.broadcast((np.array([r["q"] for r in own], dtype=np.int64), np.array([r["v"] for r in own], dtype=np.int64).view(np.uint64).reshape(-1, V.WORDS)))

        def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                batch = _present(batch, 1)
                for at in range(0, batch.num_rows, 2048):
                    piece = batch.slice(at, 2048)
                    yield _nearest(*shipped.value, piece.column("idx").to_numpy(zero_copy_only=False), matrix(piece.column("v")), k)

        found = rows.mapInArrow(scan, schema)
    else:
        blocks, chunks = -(-n // QUERY_BLOCK), max(1, -(-rows.count() // CHUNK_ROWS))
        dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
        left = asked.withColumn("block", dealt("q", blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
        right = rows.withColumn("chunk", dealt("idx", chunks)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

        def compare(a: pa.Table, b: pa.Table) -> pa.Table:
            a, b = a.filter(a["v"].is_valid()), b.filter(b["v"].is_valid())
            return pa.Table.from_batches([_nearest(a["q"].to_numpy(), matrix(a["v"]), b["idx"].to_numpy(), matrix(b["v"]), k)])

        found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(compare, schema)
    w = Window.partitionBy("query_id").orderBy("distance", "idx")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def duplicates(rows: DataFrame, fp: str = "fp", idx: str = "idx") -> DataFrame:
    """Groups of equal fingerprints: (fp_key, n, first).  Hashes of texts that differ lie about 5,000 bits apart, so
    for any similarity over 0.8 this equality is the whole pair search.  Rows are grouped by the words themselves; a key is made once a group."""
    groups = rows.groupBy(F.col(fp).alias("fp")).agg(F.count(F.lit(1)).alias("n"), F.min(idx).alias("first")).where("n > 1")
    return groups.select(F.sha2(F.concat_ws(",", F.transform("fp", lambda w: w.cast("string"))), 256).alias("fp_key"), "n", "first")


def similar_pairs(rows: DataFrame, threshold: float = 0.8, missed: float = 0.001, fp: str = "fp", idx: str = "idx") -> DataFrame:
    """(a, b, similarity), a < b: pairs of projected vectors at least ``threshold`` similar, each once.

    Bands are samples of bits, spread over the vector; pairs that agree in a whole band are compared in full.  A band has as many bits as tell all rows
    apart if they were random, and there are as many bands as let a pair at the threshold miss all of them with a probability under ``missed``
    (at 0.8 and a million rows 20 bits and 600 bands).
    Equal vectors are compared once: rows meet as representatives of their vector, and a vector's own rows are paired with its least row only
    (their similarity, 1, is transitive), so a large group of copies costs as many rows as it has members.
    """
    keyed = rows.where(F.col(fp).isNotNull()).select(F.col(idx).alias("idx"), F.col(fp).alias("v"), F.sha2(F.concat_ws(",", F.transform(F.col(fp), lambda w: w.cast("string"))), 256).alias("key"))
    keyed = cut(keyed)
    reps = cut(keyed.groupBy("key").agg(F.min_by("v", "idx").alias("v"), F.min("idx").alias("idx")))
    width = max(4, int(np.ceil(np.log2(max(2, reps.count())))))
    bands = max(1, int(np.ceil(np.log(missed) / np.log1p(-(min(threshold, 0.999) ** width)))))
    at = np.stack([np.random.default_rng([7, b]).choice(V.BITS, width, replace=False) for b in range(bands)])
    bit = lambda i: V.get_bit(F.col("v"), i).cast("int").cast("string")
    taken = F.array(*[F.array(*[F.lit(int(i)) for i in row]) for row in at])
    code = lambda places, b: F.concat(b.cast("string"), F.lit(":"), F.array_join(F.transform(places, bit), ""))
    spread = reps.select("idx", F.explode(F.transform(taken, code)).alias("band"))
    pairs = spread.withColumnRenamed("idx", "a").join(spread.withColumnRenamed("idx", "b"), "band").where("a < b").select("a", "b").distinct()
    side = lambda k: reps.select(F.col("idx").alias(k), F.col("v").alias(f"v_{k}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", V.similarity(F.col("v_a"), F.col("v_b")).alias("similarity")).where(F.col("similarity") >= threshold)
    copies = keyed.select("key", F.col("idx").alias("b")).join(reps.select("key", F.col("idx").alias("a")), "key").where("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    return near.union(copies)
