"""Approximate nearest neighbours by learned partitions.

1. A bounded sample (``SAMPLE`` rows of least hash; the bound is a parameter) meets in one task, which fits the router; the driver gets its weights.
2. Its neighbour graph is cut into balanced parts: labels move to where most of a vector's neighbours are,
   within a part's capacity.
3. A small softmax classifier learns the share of each part among a vector's neighbours.
4. Every row is indexed under its most probable part.  How many parts a query probes is fitted too: as many as give
   the recall wanted on sample queries held out from the fit.
5. Queries are routed to their most probable parts and reranked there by exact cosine.

Parts are dealt into chunks of about ``CHUNK_ROWS`` rows by a hash of the id, a part's queries into blocks of about ``BLOCK_ROWS``, so that
a part of any size, one of many equal vectors too, is spread over tasks of bounded memory; a task keeps the
nearest few of each query, and these are merged by query.  There are more parts the more rows there are, up to what the sample can tell apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

SAMPLE = 8192
#: Parts at least and at most, and the rows for each part between; a part needs so many rows of the sample.
PARTS, MOST_PARTS, PART_ROWS, PART_SAMPLE = 32, 64, 65_536, 64
NEIGHBOURS = 10
RECALL = 0.95
CHUNK_ROWS = 16384
BLOCK_ROWS = 16_384


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbours(x: np.ndarray, k: int, queries: np.ndarray | None = None) -> np.ndarray:
    """The k nearest other rows of each unit vector (of the rows ``queries`` only), in blocks."""
    rows = np.arange(len(x)) if queries is None else queries
    out = []
    for at in range(0, len(rows), 256):
        own = rows[at : at + 256]
        near = x[own] @ x.T
        near[np.arange(len(own)), own] = -np.inf
        out.append(np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def partition_graph(graph: np.ndarray, parts: int, turns: int = 40, slack: float = 1.05) -> np.ndarray:
    """Balanced parts of a neighbour graph (row i: neighbours of i), most edges inside.

    Parts begin as breadth-first runs; then, turn by turn, vertices with most to gain move first, while there is room.
    """
    n = len(graph)
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    order_by = np.argsort(source, kind="stable")
    ends, linked = np.append(0, np.cumsum(np.bincount(source, minlength=n))), target[order_by]
    seen, order = np.zeros(n, dtype=bool), []
    for root in range(n):
        if not seen[root]:
            seen[root], queue = True, [root]
            for v in queue:
                own = linked[ends[v] : ends[v + 1]]
                fresh = np.unique(own[~seen[own]])
                seen[fresh] = True
                queue.extend(fresh.tolist())
            order += queue
    label = np.empty(n, dtype=np.int64)
    label[order] = np.arange(n) * parts // n
    room = int(np.ceil(n / parts * slack))
    for _ in range(turns):
        links = np.zeros((n, parts))
        np.add.at(links, (source, label[target]), 1)
        best = links.argmax(axis=1)
        gain = links[np.arange(n), best] - links[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < room:
                size[label[v]] -= 1
                size[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """Softmax classifier over parts; a plain matrix, small enough to travel with each task."""

    def __init__(self, x: np.ndarray, target: np.ndarray, epochs: int = 60, rate: float = 2.0, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.weight, self.bias = np.zeros((x.shape[1], target.shape[1])), np.zeros(target.shape[1])
        scale = 8.0  # unit vectors' components are small
        for epoch in range(epochs):
            step = rate / (1 + epoch / 10)
            for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                wrong = self._softmax(scale * (x[own] @ self.weight) + self.bias) - target[own]
                self.weight -= step * (x[own].T @ wrong) / len(own) * scale / 8
                self.bias -= step * wrong.mean(axis=0)
        self.weight *= scale

    @classmethod
    def of(cls, weight: np.ndarray, bias: np.ndarray) -> Router:
        router = cls.__new__(cls)
        router.weight, router.bias = weight, bias
        return router

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each unit vector, most probable first."""
        return np.argsort(-(x @ self.weight + self.bias), axis=1, kind="stable")


def fit(x: np.ndarray, k: int, parts: int = PARTS, recall: float = RECALL) -> tuple[Router, int]:
    """A router for the sample's vectors and the number of parts to probe for the recall wanted."""
    x = _unit(x)
    parts = max(1, min(parts, len(x) // PART_SAMPLE))
    if parts == 1:
        return Router(x, np.ones((len(x), 1)), epochs=0), 1
    test = np.arange(0, len(x), 8)
    train = np.setdiff1d(np.arange(len(x)), test)
    graph = neighbours(x[train], NEIGHBOURS)
    label = partition_graph(graph, parts)
    target = np.zeros((len(train), parts))
    np.add.at(target, (np.repeat(np.arange(len(train)), graph.shape[1]), label[graph].reshape(-1)), 1 / graph.shape[1])
    target = 0.8 * target
    target[np.arange(len(train)), label] += 0.2
    router = Router(x[train], target)
    truth = neighbours(x, k, test)
    ranks, home = router.ranked(x[test]), router.ranked(x)[:, 0]
    place = np.empty_like(ranks)
    np.put_along_axis(place, ranks, np.arange(parts)[None, :].repeat(len(test), axis=0), axis=1)
    needed = np.sort(np.take_along_axis(place, home[truth], axis=1).reshape(-1))
    return router, int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1


def clean_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null, without null or non-finite components, not zero, and as long as most are."""
    v = F.col(embedding).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1)
    return rows.join(F.broadcast(usual.select("dim")), F.size("v") == F.col("dim"), "left_semi")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, cosine) of each query's k nearest in ``x``, its own id aside, ties to the smaller id.

    A first pass by matrix product finds all rows that may be among the k; their cosines are then computed pair by
    pair in one fixed order of addition, so equal vectors score alike wherever they lie.
    """
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    norm_x, norm_q = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    out: list[tuple[int, int, float]] = []
    for at in range(0, len(q), 256):
        rough = (q[at : at + 256] / norm_q[at : at + 256, None]) @ (x / norm_x[:, None]).T
        rough[q_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(rough, at):
            # copies of one id count once, so some more than k are looked at until k ids are found
            depth = k
            while True:
                edge = np.partition(row, len(row) - depth)[len(row) - depth] if depth < len(row) else -np.inf
                near = np.flatnonzero((row >= edge - 1e-9) & (row > -np.inf))
                if len(np.unique(ids[near])) >= k or depth >= len(row):
                    break
                depth *= 4
            score = (x[near] * q[i]).sum(axis=1) / (norm_x[near] * norm_q[i])
            found: dict[int, float] = {}
            for j in np.lexsort((ids[near], -score)):
                if len(found) == k:
                    break
                found.setdefault(int(ids[near[j]]), float(score[j]))
            out += [(int(q_ids[i]), v, s) for v, s in found.items()]
    return out


def _sampled(vectors: DataFrame, sample: int, size: int) -> DataFrame:
    """The ``sample`` rows of least hash.  About twice as many are let through by a bound on the hash first, so that what tasks
    send on for the choice does not grow with their number; equal rows count once."""
    share = min(1.0, 2 * sample / max(1, size))
    hashed = vectors.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 31)))
    few = hashed.where(F.col("h") <= int(share * (1 << 31))).dropDuplicates(["id", "v"])
    return few.orderBy("h", "id", "v").limit(sample).drop("h")


def search(df: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, parts: int | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row of ``queries`` among all rows of ``df``
    of another id, by cosine, ties to the smaller id; a query gets fewer only if there are no more.  With them n_parts and n_probed, the parts
    there are and those that each query is looked for in: how much of the index it takes depends on the vectors (where they lie in clusters a few parts, among random ones most).

    Vectors that are null, zero, hold null or non-finite components or have another length than most take no part, nor do rows without id. An id that repeats
    counts once, with its best score.  Other columns do not matter.  Without vectors or queries the result is empty.
    """
    schema = "query_id long, rank int, vec_id long, score double, n_parts int, n_probed int"
    spark = df.sparkSession
    vectors = C.written(clean_vectors(df, vec_id, embedding), "vectors")
    size = vectors.count()

    def fitted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in stream if b.num_rows]
        if batches:
            dim = len(batches[0].column("v")[0])
            x = np.concatenate([_matrix(b.column("v"), dim) for b in batches])
            router, probes = fit(x, k, parts or min(MOST_PARTS, max(PARTS, size // PART_ROWS)), recall)
            yield pa.RecordBatch.from_pylist([{"dim": dim, "parts": len(router.bias), "probes": probes, "weight": router.weight.tobytes(), "bias": router.bias.tobytes()}], pa.schema(found))

    found = [("dim", pa.int32()), ("parts", pa.int32()), ("probes", pa.int32()), ("weight", pa.binary()), ("bias", pa.binary())]
    model = _sampled(vectors, sample, size).mapInArrow(fitted, "dim int, parts int, probes int, weight binary, bias binary").collect()
    if not model:
        return spark.createDataFrame([], schema)
    dim, parts, probes = model[0]["dim"], model[0]["parts"], model[0]["probes"]
    router = Router.of(np.frombuffer(model[0]["weight"]).reshape(dim, parts), np.frombuffer(model[0]["bias"]))

    def route(count: int):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                if batch.num_rows:
                    ranks = router.ranked(_unit(_matrix(batch.column("v"), dim)))[:, :count].astype(np.int32)
                    ends = np.arange(0, ranks.size + 1, ranks.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ranks.reshape(-1)))], names=["id", "v", "parts"])

        return run

    index = vectors.mapInArrow(route(1), "id long, v array<double>, parts array<int>").select("id", "v", F.col("parts")[0].alias("part"))
    index = C.written(index, "index")
    asked = clean_vectors(queries, vec_id, embedding).where(F.size("v") == dim).dropDuplicates(["id", "v"])
    asked = C.written(asked.mapInArrow(route(probes), "id long, v array<double>, parts array<int>"), "queries")
    best = C.written(_matched(asked, index, dim, k), "found")
    # what the probed parts hold too little for is looked for in all parts
    enough = best.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    if probes < parts and enough.count() < asked.select("id").distinct().count():
        short = C.written(asked.join(enough, "id", "left_anti"), "short")
        everywhere = short.withColumn("parts", F.sequence(F.lit(0), F.lit(parts - 1)))
        best = best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_matched(everywhere, index, dim, k))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(parts).alias("n_parts"), F.lit(probes).alias("n_probed"))


def _matched(asked: DataFrame, index: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of every chunk and more for each query of ``asked`` (id, v, parts), ids once with their best score.

    A part's rows are dealt into chunks, and its own queries into blocks, each of bounded size; every block meets every chunk of the part once.  A row is
    repeated only as often as its own part has blocks of queries."""
    wanted = asked.withColumn("part", F.explode("parts")).drop("parts")
    # a row a part
    sizes = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
    sizes = sizes.join(wanted.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")), "part")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.join(F.broadcast(sizes), "part").withColumn("chunk", dealt("chunks")).withColumn("block", all_of("blocks"))
    wanted = wanted.join(F.broadcast(sizes), "part").withColumn("block", dealt("blocks")).withColumn("chunk", all_of("chunks"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = nearest(_matrix(left["v"], dim), left["id"].to_numpy(), _matrix(right["v"], dim), right["id"].to_numpy(), k) if left.num_rows and right.num_rows else []
        return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    by = ["part", "chunk", "block"]
    found = wanted.select(*by, "id", "v").groupBy(*by).cogroup(rows.select(*by, "id", "v").groupBy(*by)).applyInArrow(compare, "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
