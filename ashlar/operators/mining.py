"""Pair counts, implications, propagation and learned patterns over baskets (seq, items)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import bitvec as V
from .graph import cut
from .search import CHUNK_ROWS, QUERY_BLOCK, matrix


def pair_counts(baskets: DataFrame) -> DataFrame:
    """(a, b, n), a < b: baskets that hold both.  Pairs are made inside each basket and added up before the shuffle."""
    own = F.array_sort(F.array_distinct("items"))
    pairs = F.flatten(F.transform(own, lambda x, i: F.transform(F.filter(own, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return baskets.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def item_counts(baskets: DataFrame) -> DataFrame:
    return baskets.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def frequent_pairs(baskets: DataFrame, k: int = 5) -> DataFrame:
    return pair_counts(baskets).orderBy(F.desc("n"), "a", "b").limit(k)


def frequent_itemsets(baskets: DataFrame, least: int, sizes: tuple[int, int] = (2, 4), shards: int | None = None) -> DataFrame:
    """(items, n): sets of items, sorted, of a size within ``sizes`` that ``least`` baskets or more hold.

    Parallel FP-growth: a basket goes, cut short, to the shard of each of its frequent items, and every shard mines its own tree of what all its baskets share.
    """
    n = baskets.count()
    if not n:
        return baskets.select("items", F.lit(0).cast("long").alias("n"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (least - 0.5) / n)), **({"numPartitions": shards} if shards else {})).fit(baskets.select(F.array_distinct("items").alias("items")))
    found = model.freqItemsets.where(F.size("items").between(*sizes))
    return found.select(F.sort_array("items").alias("items"), F.col("freq").alias("n"))


def implications(baskets: DataFrame, least_confidence: float = 0.9, least_count: int = 3, least_baskets: int = 5) -> DataFrame:
    """(a, b, n, confidence): a implies b in the sorted direction."""
    pairs = pair_counts(baskets).join(item_counts(baskets).toDF("a", "n_a"), "a")
    rules = pairs.withColumn("confidence", F.col("n") / F.col("n_a")).where((F.col("confidence") >= least_confidence) & (F.col("n") >= least_count))
    enough = baskets.agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= least_baskets)
    return rules.crossJoin(F.broadcast(enough)).select("a", "b", "n", "confidence")  # one row or none


def propagation(baskets: DataFrame, least: float = 0.3) -> DataFrame:
    """(item, other, strength): baskets with both over those with the pair's first item in sorted order, in both directions alike.

    (So the second direction is divided by the other item's count, not by the item's own.)"""
    shares = pair_counts(baskets).join(item_counts(baskets).toDF("a", "n_a"), "a").withColumn("strength", F.col("n") / F.col("n_a")).where(F.col("strength") > least)
    return shares.select(F.col("a").alias("item"), F.col("b").alias("other"), "strength").union(shares.select("b", "a", "strength"))


def fanout_confirmed(baskets: DataFrame, rules: DataFrame, least: float = 0.5, wanted: int = 3) -> DataFrame:
    """(source, confirmed) for ``rules`` (source, targets): whether it spreads with over ``least`` to as many targets as there are, or to ``wanted`` of them."""
    strong = propagation(baskets).where(F.col("strength") > least).select(F.col("item").alias("source"), F.col("other").alias("target"))
    each = rules.select("source", "targets", F.explode_outer("targets").alias("target"))
    found = each.join(strong.withColumn("hit", F.lit(1)), ["source", "target"], "left").groupBy("source", "targets").agg(F.count("hit").alias("hits"))
    return found.select("source", (F.col("hits") >= F.least(F.size("targets"), F.lit(wanted))).alias("confirmed"))


#: Levels of rules, from the lowest (fixed values).
LEVELS = ("RAW", "ATOM", "STRUCTURE", "PATTERN", "SYNDROME", "PRINCIPLE", "TRANSCENDENCE")


def level_jump(rules: DataFrame, least: int = 5) -> DataFrame:
    """(level, elevated, to_level, support, common): for each level (a number) of ``rules`` (level, examples), whether it can be unified into the next: ``least``
    rules or more, and examples that occur at least half as often as there are rules; ``common`` holds up to five of them, the most frequent first."""
    sizes = rules.groupBy("level").agg(F.count(F.lit(1)).alias("support"))
    seen = rules.select("level", F.explode("examples").alias("example")).groupBy("level", "example").agg(F.count(F.lit(1)).alias("n"))
    often = seen.join(sizes, "level").where("2 * n >= support")
    first = Window.partitionBy("level").orderBy(F.desc("n"), "example")
    common = often.withColumn("k", F.row_number().over(first)).where("k <= 5").groupBy("level").agg(F.sort_array(F.collect_list(F.struct("k", "example"))).alias("c"))
    up = (F.col("support") >= least) & F.col("c").isNotNull()
    none = F.array().cast("array<string>")
    return sizes.join(common, "level", "left").select(
        "level",
        up.alias("elevated"),
        F.when(up, F.least(F.col("level") + 1, F.lit(len(LEVELS) - 1))).otherwise(F.col("level")).cast("int").alias("to_level"),
        "support",
        F.when(up, F.transform("c", lambda x: x["example"])).otherwise(none).alias("common"),
    )


def elevate(rules: DataFrame, relevance: float, least: float = 0.7) -> DataFrame:
    """One row for ``rules`` (name, level, support) taken together, or none if ``relevance`` is under ``least`` or there are fewer than two: (level, confidence, support, n_rules, impact, insight)."""
    names = rules.agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.max("level").alias("top"),
        F.sum("support").alias("support"),
        *[F.bool_or(_mentions("name", words)).alias(k) for k, words in INSIGHTS],
    )
    said = F.coalesce(*[F.when(F.col(k), k) for k, _ in INSIGHTS], F.lit("common_cause"))
    return names.where((F.col("n_rules") >= 2) & (F.lit(relevance) >= least)).select(
        F.least(F.col("top") + 1, F.lit(len(LEVELS) - 1)).cast("int").alias("level"), F.lit(float(relevance)).alias("confidence"), "support", "n_rules", (F.lit(float(relevance)) * F.col("n_rules") / 10).alias("impact"), said.alias("insight")
    )


#: Kinds of insight by words in the rules' names, first match first (fixed values).
INSIGHTS = (("too_much_breaks_together", ("GOD", "Single")), ("dependencies_amplify", ("CIRCULAR", "Coupling")), ("nesting_compounds", ("NESTING", "ARROW")))


def _mentions(column: str, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.col(column).contains(w)
    return found


def correlations(edges: DataFrame, least: float = 0.3) -> DataFrame:
    """(src, dst, strength) of observed pairs (src, dst): pairs over all of the source's appearances in either role."""
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    roles = edges.select(F.explode(F.array("src", "dst")).alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("n_src"))
    return pairs.join(roles, "src").select("src", "dst", (F.col("n") / F.col("n_src")).alias("strength")).where(F.col("strength") > least)


def emerging_patterns(baskets: DataFrame, known: DataFrame, k: int = 5, least: int = 3) -> DataFrame:
    """(a, b, n, confidence): frequent pairs that no known pattern (items) holds, confidence n / 10 up to 0.7."""
    top = pair_counts(baskets).where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(k)
    new = top.join(pair_counts(known).select("a", "b"), ["a", "b"], "left_anti")
    return new.select("a", "b", "n", F.least(F.col("n") / 10, F.lit(0.7)).alias("confidence"))


#: Items of patterns, so many at most (counted first), that travel with the tasks.
HOOKS_SENT = 100_000


def _sent(hooks: DataFrame) -> DataFrame:
    """Patterns by their items, for a join with the baskets' items: broadcast if few, so that baskets are not dealt by items, of which a few may be in most of them."""
    return F.broadcast(hooks) if hooks.limit(HOOKS_SENT + 1).count() <= HOOKS_SENT else hooks


def predict_missing(items: DataFrame, patterns: DataFrame) -> DataFrame:
    """(seq, item, score): for baskets, items of patterns (name, items, confidence) they partly hold, by the best pattern."""
    parts = patterns.select("items", "confidence").withColumnRenamed("items", "pattern").withColumn("hook", F.explode("pattern"))
    touched = items.select("seq", "items", F.explode(F.array_distinct("items")).alias("hook")).join(_sent(parts), "hook").drop("hook").distinct()
    overlap = F.size(F.array_intersect("items", "pattern"))
    score = overlap / F.size("pattern") * F.col("confidence")
    missing = touched.select("seq", F.explode(F.array_except("pattern", "items")).alias("item"), score.alias("score"))
    return missing.groupBy("seq", "item").agg(F.max("score").alias("score"))


def reinforce(baskets: DataFrame, patterns: DataFrame, gain: float = 0.1, overlap: float = 0.5) -> DataFrame:
    """(name, confidence, observations): every basket that overlaps a pattern by more than ``overlap`` adds gain x overlap, up to 1.

    Gains only add, so the order does not matter until feedback or decay come in (see learning.fold).
    """
    hooks = patterns.withColumnRenamed("items", "pattern").withColumn("hook", F.explode("pattern"))
    touched = baskets.select("seq", "items", F.explode(F.array_distinct("items")).alias("hook")).join(_sent(hooks), "hook").select("seq", "name", "items", "pattern").distinct()
    share = touched.select("name", (F.size(F.array_intersect("items", "pattern")) / F.size("pattern")).alias("s")).where(F.col("s") > overlap)
    gained = share.groupBy("name").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"))
    new = F.least(F.lit(1.0), F.col("confidence") + gain * F.coalesce("s", F.lit(0.0)))
    return patterns.join(gained, "name", "left").select("name", new.alias("confidence"), F.coalesce("n", F.lit(0)).alias("observations"))


def alike_patterns(observations: DataFrame, patterns: DataFrame, least: float = 0.7) -> DataFrame:
    """(name, seq, similarity): observations (seq, fp) whose vector is more than ``least`` similar to that of a pattern (name, fp), exactly.

    Patterns are dealt into blocks of QUERY_BLOCK; one block travels with the scan of the observations, more of them meet chunks of these in tasks of bounded size.
    """
    ids = cut(patterns.where("fp IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), "name", "fp"))
    n, most = ids.count(), int(np.floor((1 - least) * V.BITS))
    asked, seen = ids.select("id", "fp"), observations.where("fp IS NOT NULL").select("seq", "fp")
    kind = observations.schema["seq"].dataType
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("seq", kind), T.StructField("distance", T.LongType())])

    def near(p_ids: np.ndarray, p: np.ndarray, seqs: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        found = [(i, row, d[row]) for i, q in zip(p_ids, p, strict=True) for d in [np.bitwise_count(x ^ q).sum(axis=1, dtype=np.int64)] for row in np.flatnonzero(d < most)]
        rows = pa.array([f[1] for f in found], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), seqs.take(rows), pa.array([f[2] for f in found], pa.int64())], names=["id", "seq", "distance"])

    if n <= QUERY_BLOCK:
        own = asked.collect()
        shipped = ids.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in own], dtype=np.int64), np.array([r["fp"] for r in own], dtype=np.int64).view(np.uint64).reshape(-1, V.WORDS)))

        def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    yield near(*shipped.value, part.column("seq"), matrix(part.column("fp")))

        found = seen.mapInArrow(scan, schema)
    else:
        blocks, chunks = -(-n // QUERY_BLOCK), max(1, -(-seen.count() // CHUNK_ROWS))
        each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(int(m) - 1)))
        dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(int(m))).cast("int")
        left = asked.select(dealt("id", blocks).alias("block"), each(chunks).alias("chunk"), "id", F.lit(None).cast(kind).alias("seq"), "fp")
        right = seen.select(each(blocks).alias("block"), dealt("seq", chunks).alias("chunk"), F.lit(None).cast("long").alias("id"), "seq", "fp")

        def compare(table: pa.Table) -> pa.Table:
            a, b = table.filter(table["id"].is_valid()), table.filter(table["id"].is_null())
            return pa.Table.from_batches([near(a["id"].to_numpy(), matrix(a["fp"]), b["seq"].combine_chunks(), matrix(b["fp"]))])

        found = left.unionByName(right).groupBy("block", "chunk").applyInArrow(compare, schema)
    return found.join(ids.select("id", "name"), "id").select("name", "seq", (1 - F.col("distance") / F.lit(float(V.BITS))).alias("similarity"))


def reinforce_alike(observations: DataFrame, patterns: DataFrame, gain: float = 0.1, least: float = 0.7) -> DataFrame:
    """(name, confidence, observations) of patterns (name, fp, confidence): every observation more than ``least`` similar adds gain x similarity, up to 1."""
    gained = alike_patterns(observations, patterns, least).groupBy("name").agg(F.sum("similarity").alias("s"), F.count(F.lit(1)).alias("n"))
    new = F.least(F.lit(1.0), F.col("confidence") + gain * F.coalesce("s", F.lit(0.0)))
    return patterns.join(gained, "name", "left").select("name", new.alias("confidence"), F.coalesce("n", F.lit(0)).alias("observations"))


def decayed(patterns: DataFrame, observed_enough: int = 3) -> DataFrame:
    """One epoch: confidences x 0.95, or x 0.855 under ``observed_enough`` observations; patterns that fall under 0.1 with fewer than 10 observations go."""
    new = F.col("confidence") * F.when(F.col("observations") < observed_enough, 0.95 * 0.9).otherwise(0.95)
    return patterns.withColumn("confidence", new).where("not (confidence < 0.1 and observations < 10)")


#: Patterns known beforehand: kind, name, items or steps (fixed values).
SEED_PATTERNS = (
    ("SYNDROME", "God Object Syndrome", ("GOD_CLASS", "LONG_METHOD", "FEATURE_ENVY")),
    ("SYNDROME", "Spaghetti Tangle", ("DEEP_NESTING", "SPAGHETTI", "LONG_METHOD")),
    ("SYNDROME", "Dependency Hell", ("CIRCULAR_DEPENDENCY", "SHOTGUN_SURGERY", "FEATURE_ENVY")),
    ("SYNDROME", "Copy-Paste Inheritance", ("DUPLICATED_CODE", "PARALLEL_INHERITANCE")),
    ("REFACTORING_RECIPE", "Extract Class", ("GOD_CLASS",)),
    ("REFACTORING_RECIPE", "Flatten Arrow", ("DEEP_NESTING",)),
    ("CODE_IDIOM", "Repository Pattern", ("find", "save", "delete", "query")),
    ("CODE_IDIOM", "Service Layer", ("execute", "handle", "process")),
    ("ANTI_IDIOM", "Manager Class", ("Manager", "Handler", "Helper", "Util")),
)
#: Principles known beforehand and the smell that each speaks of (fixed values).
SEED_PRINCIPLES = (
    ("Single Responsibility", "GOD_CLASS"),
    ("Low Coupling", "tight_coupling"),
    ("High Cohesion", "FEATURE_ENVY"),
    ("Acyclic Dependencies", "CIRCULAR_DEPENDENCY"),
    ("Shallow Nesting", "ARROW_CODE"),
)


def seed_patterns(spark: SparkSession) -> DataFrame:
    """(kind, name, items, confidence, observations): the patterns known beforehand; a recipe's items are the smells it mends."""
    return spark.createDataFrame([(k, n, list(i), 0.8, 10) for k, n, i in SEED_PATTERNS], "kind string, name string, items array<string>, confidence double, observations long")


def seed_principles(spark: SparkSession) -> DataFrame:
    """(name, level, smell, confidence, support, examples): the principles known beforehand."""
    rows = [(n, LEVELS.index("PRINCIPLE"), s, 0.95, 100, []) for n, s in SEED_PRINCIPLES]
    return spark.createDataFrame(rows, "name string, level int, smell string, confidence double, support long, examples array<string>")


def suggested_fixes(baskets: DataFrame, patterns: DataFrame) -> DataFrame:
    """(seq, name, score) by score: syndromes (kind SYNDROME) of which a basket holds over 0.3, scored overlap x confidence, and recipes for a smell it holds, scored by confidence."""
    hooks = patterns.where("kind in ('SYNDROME', 'REFACTORING_RECIPE')").select("kind", "name", "confidence", F.array_distinct("items").alias("pattern"))
    touched = baskets.select("seq", F.explode(F.array_distinct("items")).alias("hook")).join(_sent(hooks.withColumn("hook", F.explode("pattern"))), "hook")
    held = touched.groupBy("seq", "kind", "name", "confidence", F.size("pattern").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("size")
    score = F.when(F.col("kind") == "SYNDROME", F.when(share > 0.3, share * F.col("confidence"))).otherwise(F.col("confidence"))
    return held.select("seq", "name", score.alias("score")).where("score is not null").orderBy("seq", F.desc("score"), "name")


#: Sketches of table_stats: bits of the distinct count's registers (error about 1.04 / sqrt(2**bits)), parts of a quantile's accuracy, items that are tracked.
DISTINCT_BITS, QUANTILE_PARTS, TRACKED = 14, 10_000, 1_000


def table_stats(df: DataFrame, k: int = 3) -> DataFrame:
    """A row for each column (column_name, n, nulls, low, high, distinct_about, quartiles_about, top_about, encoding) in one pass over the table.

    Counts and bounds are exact, all else comes from sketches that tasks make and that are merged: HyperLogLog for distinct values, quantile summaries for numbers
    (ranks off by a 10,000th of the rows at most), tracked items for the ``k`` most frequent values.  Values are shown as text.
    """
    numbers = {c for c, kind in df.dtypes if kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")}
    parts = []
    for i, c in enumerate(df.columns):
        v = F.col("`" + c.replace("`", "``") + "`")
        quartiles = F.percentile_approx(v.cast("double"), [0.25, 0.5, 0.75], QUANTILE_PARTS) if c in numbers else F.lit(None).cast("array<double>")
        top = F.transform(F.call_function("approx_top_k", v.cast("string"), F.lit(k), F.lit(TRACKED)), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n")))
        parts += [F.count(v).alias(f"n{i}"), F.count_if(v.isNull()).alias(f"z{i}"), F.min(v).cast("string").alias(f"l{i}"), F.max(v).cast("string").alias(f"h{i}")]
        parts += [F.call_function("hll_sketch_estimate", F.call_function("hll_sketch_agg", v.cast("string"), F.lit(DISTINCT_BITS))).alias(f"d{i}"), quartiles.alias(f"q{i}"), top.alias(f"t{i}")]
    one = df.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{p}{i}").alias(x) for p, x in zip("nzlhdqt", ("n", "nulls", "low", "high", "distinct_about", "quartiles_about", "top_about"), strict=True)]) for i, c in enumerate(df.columns)]
    share = F.col("distinct_about") / F.col("n")
    encoding = F.when(F.col("n") == 0, "PLAIN").when(F.col("low") == F.col("high"), "ONE_VALUE").when(share < 0.5, "DICTIONARY").otherwise("PLAIN")
    return one.select(F.inline(F.array(*rows))).withColumn("encoding", encoding)


def column_stats(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """One row of statistics of a column over all rows, and the encoding they advise.

    n, nulls, distinct_values, low, high, mode (the least of the most frequent values) and its share of the values; with ``order`` (a column that orders the rows and is unique
    nearly everywhere) also in_order, runs and mean_run.  Rows are ranged by ``order`` and compared with their neighbour inside a range; a range's ends are
    compared with the next range's, one row per range."""
    values = df.select(F.col(column).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    some = values.where("v is not null")
    stats = some.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count("v").alias("distinct_values"), F.min("v").alias("low"), F.max("v").alias("high"), F.min(F.struct((-F.col("k")).alias("less"), "v")).alias("top"))
    stats = stats.crossJoin(values.agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("nulls")))  # one row each
    share = F.col("distinct_values") / F.col("n")
    encoding = F.when(F.col("distinct_values") == 1, "ONE_VALUE").when(share < 0.5, "DICTIONARY").otherwise("PLAIN")
    out = stats.select("n", "nulls", "distinct_values", "low", "high", F.col("top.v").alias("mode"), (-F.col("top.less") / F.col("n")).alias("mode_share"), encoding.alias("encoding"))
    return out if order is None else out.crossJoin(_runs(df.select(F.col(column).alias("v"), F.col(order).alias("o")))).withColumn("mean_run", F.when(F.col("runs") > 0, F.col("n") / F.col("runs")))


def _runs(rows: DataFrame) -> DataFrame:
    """One row (in_order, runs) of the values v that are not null, in the order of o."""
    ranged = rows.where("v is not null").repartitionByRange("o").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)
    before = F.lag("v").over(Window.partitionBy("part").orderBy("o", "v"))
    steps = ranged.withColumn("before", before)
    parts = steps.groupBy("part").agg(
        F.count_if(F.col("before").isNull() | (F.col("before") != F.col("v"))).alias("runs"), F.count_if(F.col("before") > F.col("v")).alias("falls"), F.min_by("v", F.struct("o", "v")).alias("first"), F.max_by("v", F.struct("o", "v")).alias("last")
    )
    # one row per range of the sort
    last = F.lag("last").over(Window.orderBy("part"))
    joined = parts.withColumn("last", last)
    return joined.agg((F.coalesce(F.sum("falls"), F.lit(0)) + F.count_if(F.col("last") > F.col("first")) == 0).alias("in_order"), (F.coalesce(F.sum("runs"), F.lit(0)) - F.count_if(F.col("last") == F.col("first"))).alias("runs"))
