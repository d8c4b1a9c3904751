"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

1. Every text's set of distinct shingles (64-bit hashes of ``words`` lower-cased words; with fewer, the whole sequence
   is one shingle) is sketched: rounds of hashed bin placement put each shingle into one of ``BINS`` bins per round, a bin
   keeps its least (round, value), and rounds stop once every bin is filled; from round BINS on, each round fills one
   bin for certain.  Two sketches agree in a bin with the probability of the sets' Jaccard similarity.
2. Texts with the same set are one node from here on, so copies never meet each other.
3. Sketches are cut into ``BANDS`` bands of ``ROWS`` bins; nodes with an equal band share a bucket.  At similarity 0.85 a pair
   shares none of the 40 bands with probability 6e-9.
4. Buckets are searched from pivots: first every member is held against the bucket's first, on full
   sets.  Verified links make components; a bucket whose members are in one component is settled.  In those that are not, the
   ``CENTRAL`` members with most links are held against the members of other components, and in those still not settled
   every member outside the largest component is, large buckets block by block.  Before that, profiles of their sets (how many
   shingles fall into each class of hashes) bound every pair's similarity from above, and only pairs whose bound reaches the threshold are verified.  So a group of m near copies costs about m pairs, and no pair that could still join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _common as C
from . import _text as X
from .graphs import components

BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Classes of a set's profile.
PROFILE = 64
#: Members with most links that are pivots in the second turn; near copies are mostly linked to what they were copied from.
CENTRAL = 4
#: Open buckets of more members are compared in blocks, in tasks of two blocks each.
SMALL, BLOCK = 128, 1024

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, counts = X.word_hashes(column)
    sets, at = [], 0
    for n in counts.tolist():
        own = hashes[at : at + n]
        at += n
        size = min(n, words)
        if not n:
            sets.append(own)
            continue
        out = own[: n - size + 1] ^ np.uint64(size)
        for k in range(1, size):
            out = X.chain(out, own[k : n - size + 1 + k])
        sets.append(np.unique(out))
    return sets


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` numbers a set; sets must not be empty."""
    out = np.full((len(sets), bins), _FULL, dtype=np.uint64)
    flat = out.reshape(-1)
    open_ = np.arange(len(sets))
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    seeds = _SALT * np.arange(1, 4 * bins, 2, dtype=np.uint64)
    for turn in range(2 * bins):
        if not len(open_):
            break
        h = X.mix(items + seeds[turn])
        value = (h >> np.uint64(12)) | (np.uint64(turn) << np.uint64(52))
        base = np.repeat(open_ * bins, sizes)
        if turn < bins:
            place = base + (((h & np.uint64(0xFFFFFFFF)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
        else:
            place = base + (turn - bins)
        np.minimum.at(flat, place, value)
        still = (out[open_] == _FULL).any(axis=1)
        if not still.all():
            items = items[np.repeat(still, sizes)]
            sizes, open_ = sizes[still], open_[still]
    return out


def _bands(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _SALT, (len(sketch), bands)).copy()
    for k in range(rows):
        h = X.chain(h, parts[:, :, k])
    return h


def sketch_table(df: DataFrame, doc_id: str, text: str, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, th, n, k1, k2, bands): th hashes the text, k1 and k2 the set; an empty set has no bands."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.batches(stream, "text", 4 << 20):
            sets = shingle_sets(batch.column("text"), words)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            some = np.flatnonzero(n)
            keys = np.zeros((2, len(sets)), dtype=np.uint64)
            lists = np.zeros((0, bands), dtype=np.uint64)
            if len(some):
                full = [sets[i] for i in some]
                items, starts = np.concatenate(full), np.cumsum(n[some]) - n[some]
                keys[0, some] = np.add.reduceat(X.mix(items + _SALT), starts)
                keys[1, some] = np.add.reduceat(X.mix(items ^ _SALT), starts)
                lists = _bands(sketches(full, bands * rows), bands, rows)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(n), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), listed], names=["id", "th", "n", "k1", "k2", "bands"])

    rows_in = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    return rows_in.mapInArrow(run, "id long, th long, n long, k1 long, k2 long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.batches(stream, "text_b", 2 << 20):
            a, b = batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)
            left: dict[int, np.ndarray] = {}
            found = []
            for i, other in enumerate(shingle_sets(batch.column("text_b"), words)):
                if a[i] not in left:
                    left[a[i]] = shingle_sets(batch.column("text_a").slice(i, 1), words)[0]
                own = left[a[i]]
                both = len(own) + len(other) - len(np.union1d(own, other))
                found.append(100 * both >= percent * (len(own) + len(other) - both))
            keep = np.array(found, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _profiles(texts: DataFrame, words: int) -> DataFrame:
    """(node, profile): how many shingles of each node's set fall into each of ``PROFILE`` classes by hash.

    Two sets differ by as many shingles at least as their profiles do, which bounds their similarity from above."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.batches(stream, "text", 1 << 20):
            counts = [np.bincount((X.mix(s) % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE) for s in shingle_sets(batch.column("text"), words)]
            ends = np.arange(0, len(counts) * PROFILE + 1, PROFILE, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(counts).astype(np.int32)))], names=["node", "profile"])

    return texts.select("node", "text").mapInArrow(run, "node long, profile array<int>")


def _open_members(members: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that still hold more than one component, with the bucket's size, their number of links
    and whether they belong to the bucket's largest component.  A bucket of two was settled by its pivot."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    own = members.join(labels.join(degree, "node", "left"), "node", "left").select("band", "no", "node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
    sizes = own.groupBy("band", "component").agg(F.count(F.lit(1)).alias("m"))
    open_ = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "component")).alias("most"), F.sum("m").alias("size")).where("parts > 1 and size > 2")
    rows = own.join(open_.select("band", "size", F.col("most.component").alias("most")), "band")
    return rows.select("band", "no", "node", "n", "component", "degree", "size", (F.col("component") == F.col("most")).alias("largest"))


def _possible(percent: int) -> Column:
    """Whether two sets' sizes and profiles let them reach the similarity, and the band is the first that both share."""
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    differ = F.aggregate(F.zip_with("profile_a", "profile_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    bound = 100 * (F.col("n_a") + F.col("n_b") - differ) >= percent * (F.col("n_a") + F.col("n_b") + differ)
    here = F.array_position(F.zip_with("codes_a", "codes_b", lambda x, y: x == y), True) == F.col("no_a") + 1
    return (F.col("component_a") != F.col("component_b")) & close & bound & here


def _side(rows: DataFrame, k: str) -> DataFrame:
    return rows.select("band", *[F.col(c).alias(f"{c}_{k}") for c in ("no", "node", "n", "component", "largest", "profile", "codes")], *[c for c in ("salt",) if c in rows.columns])


def _candidates(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("component_a").alias("c_a"), F.col("component_b").alias("c_b"))


def _central_pairs(ranked: DataFrame, percent: int) -> DataFrame:
    """(a, b, c_a, c_b): the ``CENTRAL`` members with most links of each bucket against its members of other components.

    The few are found with a limit before the shuffle, and a large bucket's members are dealt over salts, which each get the few."""
    salts = F.ceil(F.col("size") / BLOCK).cast("int")
    order = Window.partitionBy("band").orderBy(F.desc("degree"), "node")
    few = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CENTRAL)
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    dealt = ranked.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    found = _candidates(_side(few, "a").join(_side(dealt, "b"), ["band", "salt"]).where(_possible(percent)))
    turned = F.col("a") > F.col("b")
    ordered = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("c_b")).otherwise(F.col("c_a")).alias("c_a"), F.when(turned, F.col("c_a")).otherwise(F.col("c_b")).alias("c_b"))
    return ordered.dropDuplicates(["a", "b"])


def _other_pairs(ranked: DataFrame, percent: int) -> DataFrame:
    """(a, b, c_a, c_b): members outside a bucket's largest component against its members of other components.

    Buckets of up to ``SMALL`` members are joined with themselves.  A larger one is cut into blocks of about ``BLOCK`` members; each two blocks meet
    in a task of their own, which looks at profiles in place and sends on the pairs that may be alike, so no task holds a bucket and no pair is a row before it is bounded."""
    small = ranked.where(F.col("size") <= SMALL)
    once = F.col("largest_b") | (F.col("node_b") > F.col("node_a"))
    joined = _candidates(_side(small, "a").where("not largest_a").join(_side(small, "b"), "band").where(once & _possible(percent)))

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = ranked.where(F.col("size") > SMALL).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "no", "node", "n", "component", "largest", "profile", "codes")

    def compare(table: pa.Table) -> pa.Table:
        column = {c: table[c].to_numpy() for c in ("low", "high", "own", "no", "node", "n", "component", "largest")}
        wide = {c: np.stack(table[c].to_numpy()) for c in ("profile", "codes")}
        same = column["low"][0] == column["high"][0]
        left = np.flatnonzero(column["own"] == column["low"][0])
        right = left if same else np.flatnonzero(column["own"] == column["high"][0])
        found = [np.zeros((2, 0), dtype=np.int64)]
        for at in range(0, len(left), 128):
            own = left[at : at + 128]
            size_a, size_b = column["n"][own][:, None], column["n"][right][None, :]
            near = (column["component"][own][:, None] != column["component"][right][None, :]) & ~(column["largest"][own][:, None] & column["largest"][right][None, :])
            near &= np.minimum(size_a, size_b) * 100 >= np.maximum(size_a, size_b) * percent
            if same:
                near &= own[:, None] < right[None, :]
            i, j = np.nonzero(near)
            a, b = own[i], right[j]
            differ = np.abs(wide["profile"][a] - wide["profile"][b]).sum(axis=1)
            total = column["n"][a] + column["n"][b]
            ok = 100 * (total - differ) >= percent * (total + differ)
            a, b = a[ok], b[ok]
            shared = wide["codes"][a] == wide["codes"][b]
            first = shared.any(axis=1) & (shared.argmax(axis=1) == column["no"][0])
            found.append(np.stack([a[first], b[first]]))
        a, b = np.concatenate(found, axis=1)
        return pa.table([pa.array(column[c][x], pa.int64()) for c in ("node", "component") for x in (a, b)], names=["a", "b", "c_a", "c_b"])

    blocked = dealt.groupBy("band", "low", "high").applyInArrow(compare, "a long, b long, c_a long, c_b long")
    return joined.union(blocked)


def _merged(labels: DataFrame, between: DataFrame) -> DataFrame:
    """Labels after links between components; only the components linked are looked at again."""
    new = C.written(components(between.distinct()), "merged")
    known = labels.select("node", "component").union(new.select("node", F.col("node").alias("component"))).distinct()
    return C.written(known.join(new.toDF("component", "new"), "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``df``: doc_id, text_hash, n_shingles, component_id (least id reachable over links) and kept.

    Documents are linked if 100 * intersection >= percent * union of their sets.  A null or empty text, or one without
    words, has an empty set and is linked with nothing: component_id is its own id and it is kept.  Rows with
    equal texts are linked, whatever their ids; rows with the same id are kept or not alike; a row without id is kept only if no row of
    its component has one.  Other columns do not matter; an empty table gives an empty table.
    With the default bands a similarity of ``percent`` under 80 would need more of them.
    """
    sketched = C.written(sketch_table(df, doc_id, text, words, bands, rows), "sketches")
    some = sketched.where("n > 0")
    sets = C.written(some.groupBy("k1", "k2").agg(F.min("th").alias("node"), F.min("id").alias("rep"), F.first("n").alias("n")), "sets")

    # a bucket's first member is found with partial aggregation, then the members are joined with that one row
    firsts = some.join(sets.select(F.col("node").alias("th"), "k1", "k2"), ["th", "k1", "k2"], "left_semi").dropDuplicates(["th", "k1", "k2"])
    firsts = C.written(firsts.select(F.col("th").alias("node"), "n", "bands"), "firsts")
    exploded = firsts.select("node", "n", F.posexplode("bands").alias("no", "band"))
    buckets = exploded.groupBy("band").agg(F.min(F.struct("node", "n")).alias("pivot"), F.max("node").alias("last")).where("pivot.node <> last").drop("last")
    members = C.written(exploded.join(buckets, "band"), "members")

    wanted = df.select(F.xxhash64(F.col(text)).alias("node"), F.col(text).alias("text")).join(members.select("node").distinct(), "node", "left_semi")
    texts = C.written(wanted.groupBy("node").agg(F.min("text").alias("text")), "texts")

    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    pairs = members.where("node <> pivot.node").select(F.col("pivot.node").alias("a"), F.col("pivot.n").alias("n_a"), F.col("node").alias("b"), F.col("n").alias("n_b"))
    tested = C.written(pairs.where(close).select("a", "b").distinct(), "pairs")
    links = C.written(_verified(tested, texts, words, percent), "verified")
    labels = components(links)

    for pairs_of in (_central_pairs, _other_pairs):
        open_ = C.written(_open_members(members, labels, links), "open")
        if open_.isEmpty():
            break
        # the bands tell which one two nodes share first; the pair is looked at there only
        nodes = C.written(open_.select("node").distinct(), "nodes")
        codes = firsts.join(nodes, "node", "left_semi").select("node", F.col("bands").alias("codes"))
        known = C.written(codes.join(_profiles(texts.join(nodes, "node", "left_semi"), words), "node"), "known")
        more = C.written(pairs_of(open_.join(known, "node"), percent), "pairs")
        fresh = C.written(_verified(more.select("a", "b"), texts, words, percent), "verified")
        links = links.union(fresh)
        labels = _merged(labels, fresh.join(more, ["a", "b"]).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))

    joined = sets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = C.written(joined.join(least, "component").select("k1", "k2", "component_id"), "classes")
    result = sketched.select("id", "th", "n", "k1", "k2").join(final, ["k1", "k2"], "left")
    # an empty set's keys are 0 and found in no class
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    kept = F.coalesce(F.col("id") == component, component.isNull())
    return result.select(F.col("id").alias("doc_id"), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
