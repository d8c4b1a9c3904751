"""URL filters by a temporal list join.

A list's dated entries (a pattern goes on or comes off in a category) become validity intervals per pattern
and category, and each capture is judged as of its fetch time: by the entries active just then, never by
later ones.  A pattern is a domain, which also matches its subdomains, or a host with the beginning of a path, by whole segments.

A capture's keys are its host's suffixes and its path's prefixes, as deep as the list goes.  Captures alike in url
and time are judged once (counted by partial aggregation, so a hot url is one row per task).  The
list holds one row per pattern; it is broadcast if it has at most ``BROADCAST_INTERVALS`` (counted first), else both sides are shuffled on
the key, one row per pattern against the captures' rows, a join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

#: The list travels with the tasks if it has so many intervals at most.
BROADCAST_INTERVALS = 100_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if the url has no scheme and host."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _segments(text: Column, by: str) -> Column:
    return F.filter(F.split(text, by), lambda x: x != "")


def url_keys(url: Column, labels: int, depth: int) -> Column:
    """The keys a list may hold for a url: suffixes of the host up to ``labels`` labels, the host, and host and path up to ``depth`` segments."""
    host, names, path = host_of(url), _segments(host_of(url), r"\."), _segments(path_of(url), "/")
    none = F.array().cast("array<string>")
    few = F.least(F.size(names), F.lit(labels))
    suffixes = F.when(few > 0, F.transform(F.sequence(F.lit(1), few), lambda i: F.array_join(F.slice(names, F.size(names) - i + 1, i), "."))).otherwise(none)
    deep = F.least(F.size(path), F.lit(depth))
    prefixes = F.when(deep > 0, F.transform(F.sequence(F.lit(1), deep), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, i), "/")))).otherwise(none)
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) from (pattern, category, at, action: add or remove).

    An interval ends at the next change and is open (valid_to null) after the last; repeated adds go on one interval. Of
    entries at the same time a removal wins.  Rows with a null pattern or time are left out; a null category is a category.
    """
    once = entries.where(F.col("pattern").isNotNull() & F.col("at").isNotNull()).groupBy("pattern", "category", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("pattern", "category").orderBy("at")
    changes = once.withColumn("before", F.lag("action").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("action")))
    ended = changes.withColumn("valid_to", F.lead("at").over(w)).where(F.col("action") == "add")
    return ended.select(F.regexp_replace(F.col("pattern"), "/+$", "").alias("pattern"), "category", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Every row of ``captures`` with ``blocked`` (boolean) and ``matches``, the array of (pattern, category,
    valid_from) active at its fetch time, sorted.

    An interval holds from its first instant and no longer at its last.  A null or unreadable url, or a null fetch time,
    matches nothing.  Repeated rows are judged alike; other columns may have any names, and if an added one is taken a number follows.
    An empty list blocks nothing; an empty table gives an empty table.
    """
    blocked, matches, of_url, at_time = C.free_names(captures.columns, "blocked", "matches", "of_url", "at_time")
    valid = C.written(intervals(entries), "intervals")
    size = valid.agg(F.max(F.size(F.split("pattern", r"[./]"))).alias("labels"), F.max(F.size(F.split("pattern", "/"))).alias("depth")).first()
    listed = valid.groupBy("pattern").agg(F.collect_list(F.struct("pattern", "category", "valid_from", "valid_to")).alias("known"))
    few = valid.count() <= BROADCAST_INTERVALS

    rows = captures.select(F.col(url).alias("u"), F.col(fetched).alias("t")).where("u is not null and t is not null").distinct()
    keyed = rows.withColumn("pattern", F.explode(url_keys(F.col("u"), size["labels"] or 0, (size["depth"] or 1) - 1)))
    joined = keyed.join(F.broadcast(listed) if few else listed, "pattern")
    active = F.filter("known", lambda k: (k["valid_from"] <= F.col("t")) & (k["valid_to"].isNull() | (F.col("t") < k["valid_to"])))
    active = F.transform(active, lambda k: F.struct(k["pattern"].alias("pattern"), k["category"].alias("category"), k["valid_from"].alias("valid_from")))
    # a capture has few keys, so its matches are few however large the list
    judged = joined.withColumn("active", active).where(F.size("active") > 0).groupBy("u", "t").agg(F.sort_array(F.flatten(F.collect_list("active"))).alias(matches))
    judged = judged.withColumnsRenamed({"u": of_url, "t": at_time})
    out = captures.join(judged, (F.col(url) == F.col(of_url)) & (F.col(fetched) == F.col(at_time)), "left")
    empty = F.array().cast(judged.schema[matches].dataType)
    return out.withColumn(matches, F.coalesce(matches, empty)).withColumn(blocked, F.size(matches) > 0).select(*[C.keyed(c) for c in captures.columns], blocked, matches)
