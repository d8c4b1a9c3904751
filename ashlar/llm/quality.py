"""Quality rules per document and per host, with DataFrame functions only.

Document rules count words, symbols, repeated lines and repeated three-word windows of the whole text.
Host rules add the failures up by host (``source``), shrink each host's rate towards the corpus with a
beta prior fitted to the hosts' own rates (method of moments, the empirical part), and reject the
documents of a host whose shrunken rate is over ``max_host_rate``.

Texts never move: the measures are array expressions on the row.  Failures are added up before the
shuffle, so a host with a third of all rows costs one row per task.  The verdicts are broadcast if there
are at most ``broadcast_hosts`` (counted first); beyond that they are joined with the documents' host
salted, so that no task gets a whole large host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

MIN_WORDS = 50
#: A document fails if more than this percentage of its words lies in repeated three-word windows.
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
BROADCAST_HOSTS = 100_000
SALTS = 64

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often the result mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(tokens: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are sorted with their places; equal neighbours are the repeated ones.  The places,
    sorted again, tell how many words they cover: three each, less what the next one covers too.
    """

    def covered(windows: Column) -> Column:
        def places(order: Column) -> Column:
            same = lambda i, j: order[i]["w"] == order[j]["w"]
            last = F.size(order) - 1
            return F.filter(order, lambda x, i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < last) & same(F.least(i + 1, last), i)))

        def length(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.when(i < F.size(at) - 1, F.least(F.lit(3), at[F.least(i + 1, F.size(at) - 1)] - p)).otherwise(F.lit(3)))
            return F.aggregate(steps, F.lit(0), lambda n, x: n + x)

        repeated = _with(F.sort_array(windows), places)
        return _with(F.sort_array(F.transform(repeated, lambda x: x["i"])), length)

    windows = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 3), lambda i: F.xxhash64(t[i], t[i + 1], t[i + 2]))
    placed = lambda h: F.transform(h, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    # most texts repeat no window, which a set of their hashes tells without sorting
    found = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(placed(h))).otherwise(F.lit(0))
    return F.when(F.size(tokens) >= 4, _with(windows(tokens), found)).otherwise(F.lit(0))


def _measures(tokens: Column, text: Column) -> Column:
    """``tokens`` and ``text`` should be bound: they are mentioned many times."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return F.struct(
        F.size(tokens).cast("long").alias("n_words"),
        F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _with(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        _repeated_words(tokens).cast("long").alias("n_repeat_words"),
    )


def document_measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text counts as empty."""
    words = lambda bare: F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    tokens = lambda t: _with(F.btrim(t, F.lit(SPACES)), words)
    return _with(F.coalesce(text, F.lit("")), lambda t: _with(tokens(t), lambda w: _measures(w, t)))


def host_rates(marked: DataFrame, host: Column, failed: Column) -> DataFrame:
    """Per host: n, failures, rate, and shrunken_rate = (failures + a) / (n + a + b).

    a and b come from the mean and the variance of the hosts' rates, the variance less what sampling
    alone would give; with one host, or hosts that differ no more than by chance, the prior is as strong as the corpus.
    A null host is one host.
    """
    by_host = marked.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("failures"))
    by_host = by_host.withColumn("rate", F.col("failures") / F.col("n"))
    # exactly reproducible on any partitioning: whole numbers and decimals add up alike in any order
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    prior = by_host.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n").alias("all_n"),
        F.sum("failures").alias("all_failures"),
        exact(F.col("rate")).alias("s1"),
        exact(F.col("rate") * F.col("rate")).alias("s2"),
        exact(1 / F.col("n")).alias("inverse"),
    )
    mean = F.col("all_failures") / F.col("all_n")
    spread = F.greatest(F.col("s2") / F.col("hosts") - F.pow(F.col("s1") / F.col("hosts"), 2), F.lit(0.0))
    noise = mean * (1 - mean) * F.col("inverse") / F.col("hosts")
    between = F.greatest(spread - noise, F.lit(0.0))
    strength = F.when(between > 0, F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0)), F.col("all_n").cast("double"))).otherwise(F.col("all_n").cast("double"))
    prior = prior.select(mean.alias("m"), strength.alias("k"))
    # one row of two numbers
    return by_host.crossJoin(F.broadcast(prior)).select("host", "n", "failures", "rate", ((F.col("failures") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k"))).alias("shrunken_rate"))


def assess(
    df: DataFrame,
    text: str = "text",
    host: str = "source",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_host_rate: float = MAX_HOST_RATE,
    broadcast_hosts: int = BROADCAST_HOSTS,
    keep_text: bool = True,
) -> DataFrame:
    """Every row of ``df`` with ``quality``: a struct of the five measures, base_failed, host_rate and kept.

    A null text counts as empty and fails for its want of words; null hosts are one host; repeated
    rows are judged alike; an empty table gives an empty table; if the name is taken, a number follows.
    The rows are measured once, into the shared folder, and read from there for both the hosts' rates and
    the result; without ``keep_text`` the text column is left out of that table and of the result.
    """
    name, own, rate, salt, salted_as = C.free_names(df.columns, "quality", "own", "rate", "salt", "salted_as")
    measured = df.withColumn(name, document_measures(F.col(text)))
    failed = (F.col(f"{name}.n_words") < min_words) | (100 * F.col(f"{name}.n_repeat_words") > max_repeat_percent * F.col(f"{name}.n_words"))
    measured = measured.withColumn(name, F.col(name).withField("base_failed", failed))
    measured = C.written(measured if keep_text else measured.drop(text), "quality")

    failures = host_rates(measured, F.col(host), F.col(f"{name}.base_failed"))
    rates = C.written(failures.select(F.col("host").alias(own), F.col("shrunken_rate").alias(rate)), "hosts")
    if rates.count() <= broadcast_hosts:
        joined = measured.join(F.broadcast(rates), F.col(host).eqNullSafe(F.col(own)), "left")
    else:
        salts = rates.withColumn(salted_as, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = measured.withColumn(salt, F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
        joined = salted.join(salts, F.col(host).eqNullSafe(F.col(own)) & (F.col(salt) == F.col(salted_as)), "left")
    kept = ~F.col(f"{name}.base_failed") & (F.col(rate) <= max_host_rate)
    judged = joined.withColumn(name, F.col(name).withField("host_rate", F.col(rate)).withField("kept", kept))
    return judged.select(*[C.keyed(c) for c in measured.columns])
