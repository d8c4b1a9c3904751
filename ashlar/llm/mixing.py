"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, target weight x target size / own size.  A document's number
of copies inverts the Poisson distribution of that mean at a uniform number taken from a hash of seed, id and text:
the same on every machine, in any order, and for any partitioning.  A rate over ``PART_RATE`` is split into equal parts
below it and their draws, each at a uniform number of its own, are added up: the sum has the Poisson distribution of the whole rate.  Documents are exploded by their counts
and all copies are dealt out anew by a hash of seed, id, text and copy, which shuffles globally.

Sources are counted with partial aggregation.  Their rates are broadcast if there are at most
``BROADCAST_SOURCES`` (counted first), else joined with the documents' source salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .quality import _with

SEED = 17
#: Target weights are the sources' shares to this power, so that small sources are repeated and large ones thinned.
ALPHA = 0.5
BROADCAST_SOURCES = 10_000
SALTS = 64
#: Rates above this are drawn in equal parts, as exp(-rate) would vanish.
PART_RATE = 600.0


def _digest(seed: int, parts: list[Column]) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1): the first 52 bits of the MD5 of seed and parts."""
    return F.conv(F.substring(_digest(seed, list(parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson(u: Column, rate: Column) -> Column:
    """The least k whose cumulative Poisson probability is over u.

    Sums run to rate + 12 standard deviations + 24, beyond which no 52-bit uniform number reaches."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.lit(0).alias("k"))
    step = lambda s, i: F.when(u < s["sum"], s).otherwise(F.struct((s["p"] * rate / i).alias("p"), (s["sum"] + s["p"] * rate / i).alias("sum"), i.cast("int").alias("k")))
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def drawn(seed: int, parts: list[Column], rate: Column) -> Column:
    """A Poisson count of any rate: the sum of independent draws of rates up to ``PART_RATE``, the first at ``uniform(seed, *parts)``."""
    n = F.greatest(F.ceil(rate / PART_RATE), F.lit(1)).cast("int")
    one = lambda *place: _with(uniform(seed, *parts, *place), lambda u: poisson(u, rate / n))
    more = F.aggregate(F.sequence(F.lit(2), n), F.lit(0), lambda s, i: s + one(i))
    return one() + F.when(n > 1, more).otherwise(0)


def source_rates(df: DataFrame, source: str = "source", weights: DataFrame | None = None, alpha: float = ALPHA, size: int | None = None) -> DataFrame:
    """(source, rate): ``weights`` has (source, weight), any scale; without it weights are shares to the power ``alpha``.

    ``size`` is the number of documents wanted, by default as many as there are.  A source that ``weights`` lacks gets rate 0.
    """
    counts = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is not None:
        wanted = weights.select(F.col("source").alias("wanted"), F.col("weight").cast("double").alias("weight"))
        counts = counts.join(wanted, F.col("source").eqNullSafe(F.col("wanted")), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("wanted")
    else:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    # decimals add up alike in any order
    total = counts.agg(F.sum(F.col("weight").cast("decimal(38,9)")).cast("double").alias("all_weight"), F.sum("n").alias("all_n"))
    rate = F.col("weight") / F.col("all_weight") * (F.lit(float(size)) if size is not None else F.col("all_n").cast("double")) / F.col("n")
    rate = F.when(F.col("all_weight") > 0, rate).otherwise(0.0)
    return counts.crossJoin(F.broadcast(total)).select("source", rate.alias("rate"))  # total is one row


def mix_sources(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: DataFrame | None = None, alpha: float = ALPHA, size: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixture: ``df``'s columns with ``copy`` (from 1), ``rate`` and ``mix_key`` added, one row per copy.

    Rows come out dealt over the partitions by ``mix_key`` (32 hex digits) and sorted by it within them; sorting the whole by it gives one global random
    order.  Rows alike in id and text get alike counts; null ids, sources and texts count as values of their own; an empty
    table gives an empty table; added names that are taken get a number.
    """
    copy, rate, mix, own, salt, salted_as, n = C.free_names(df.columns, "copy", "rate", "mix_key", "own", "salt", "salted_as", "n")
    rates = C.written(source_rates(df, source, weights, alpha, size).toDF(own, rate), "rates")
    if rates.count() <= BROADCAST_SOURCES:
        rows = df.join(F.broadcast(rates), F.col(source).eqNullSafe(F.col(own)))
    else:
        salted = df.withColumn(salt, F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(SALTS)).cast("int"))
        salts = rates.withColumn(salted_as, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = salted.join(salts, F.col(source).eqNullSafe(F.col(own)) & (F.col(salt) == F.col(salted_as)))
    parts = [F.col(doc_id), F.col(text)]
    rows = rows.withColumn(n, drawn(seed, parts, F.col(rate))).where(F.col(n) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).withColumn(mix, _digest(seed + 1, [*parts, F.col(copy)]))
    return rows.select(*[C.keyed(c) for c in df.columns], copy, rate, mix).repartition(C.shuffle_partitions(df.sparkSession), mix).sortWithinPartitions(mix)
