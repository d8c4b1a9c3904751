"""Rule columns: presence and length checks, intents, error classes, suggestions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that, anywhere inside a lower-cased name, tell its intent, and the confidence (fixed values).
NAME_INTENTS = (
    ("validation", ("valid", "check", "verify", "assert"), 0.9),
    ("transformation", ("transform", "convert", "map", "parse"), 0.9),
    ("persistence", ("save", "load", "store", "persist", "db", "repository"), 0.9),
    ("computation", ("compute", "calculate", "sum", "avg", "count"), 0.9),
    ("logging", ("log", "trace", "debug", "info", "warn", "error"), 0.8),
    ("retry", ("retry", "backoff", "attempt"), 0.9),
    ("caching", ("cache", "memo", "remember"), 0.9),
)
BODY_INTENT = ("error_handling", ("raise", "except", "try"), 0.7)


def presence(value: Column, field: str) -> Column:
    """Struct of valid and errors: null and '' are blank."""
    blank = value.isNull() | (value.cast("string") == "")
    return F.struct((~blank).alias("valid"), F.when(blank, F.array(F.lit(f"{field} can't be blank"))).otherwise(F.array().cast("array<string>")).alias("errors"))


def length(value: Column, field: str, least: int | None = None, most: int | None = None) -> Column:
    """Struct of valid and errors; lengths in characters, null counts as '', a bound of None or 0 is none."""
    n = F.char_length(F.coalesce(value, F.lit("")))
    errors = F.array(
        F.when(n < least, F.lit(f"{field} is too short (minimum {least})")) if least else F.lit(None).cast("string"),
        F.when(n > most, F.lit(f"{field} is too long (maximum {most})")) if most else F.lit(None).cast("string"),
    )
    errors = F.array_compact(errors)
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def intents(name: Column, body: Column, fan_out: Column) -> Column:
    """Array of (intent, confidence) that the rules find."""
    entry = lambda label, confidence: F.struct(F.lit(label).alias("intent"), confidence.cast("double").alias("confidence"))
    low, text = F.lower(name), F.lower(body)
    rules = [F.when(_any(low, words), entry(label, F.lit(c))) for label, words, c in NAME_INTENTS]
    rules.append(F.when(_any(text, BODY_INTENT[1]), entry(BODY_INTENT[0], F.lit(BODY_INTENT[2]))))
    rules.append(F.when(fan_out > 3, entry("orchestration", F.least(fan_out / 6, F.lit(0.9)))))
    return F.array_compact(F.array(*rules))


def has_intent(found: Column, intent: str, threshold: float = 0.5) -> Column:
    return F.exists(found, lambda x: (x["intent"] == intent) & (x["confidence"] >= threshold))


def all_of(condition: Column) -> Column:
    """Aggregate: every row meets the condition; true for no rows."""
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True))


def exists_of(condition: Column) -> Column:
    """Aggregate: some row meets the condition; false for no rows."""
    return F.coalesce(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(False))


def none_of(condition: Column) -> Column:
    return ~exists_of(condition)


def count_of(condition: Column) -> Column:
    return F.count_if(condition)


def first_of(value: Column, condition: Column, order: Column) -> Column:
    """Aggregate: the value of the first row by ``order`` that meets the condition, or null."""
    return F.min_by(F.when(condition, value), F.when(condition, order))


def contains(edges, group, element) -> Column:
    """Aggregate over ``edges`` (src, dst, edge_type): the group holds the element."""
    return exists_of((F.col("src") == group) & (F.col("dst") == element) & (F.col("edge_type") == "CONTAINS"))


def based_on(rows, score: Column, idx: str = "id"):
    """Rows with ``score``, largest first, ties by ``idx``."""
    return rows.withColumn("score", score).orderBy(F.desc("score"), idx)


def error_class(error: Column) -> Column:
    e = F.lower(error)
    return F.when(_any(e, ("blank", "null", "empty")), "missing_input").when(_any(e, ("too short", "too long")), "length").when(_any(e, ("unique", "duplicate")), "uniqueness").otherwise("execution")


def root_cause(node: Column, error: Column, upstream: Column, failures_before: Column, failed_at: Column) -> Column:
    """Hypothesis about a failure: struct of its ``kind`` (``error_class``), ``node`` and ``error``, the ``sources`` (three at most) from which
    a missing input should come, whether the failure is ``recurring`` (two before or more) and whether the ``first_step`` failed, which speaks of bad input."""
    kind = error_class(error)
    sources = F.when(kind == "missing_input", F.slice(upstream, 1, 3)).otherwise(F.array().cast("array<string>"))
    return F.struct(kind.alias("kind"), node.alias("node"), error.alias("error"), sources.alias("sources"), (failures_before >= 2).alias("recurring"), (failed_at == 0).alias("first_step"))


def suggestion(cause: Column) -> Column:
    """What a cause (``root_cause``) calls for at its node: one of four actions."""
    return F.when(cause["kind"] == "missing_input", "provide_input").when(cause["recurring"], "validate_upstream").when(cause["kind"] == "length", "check_length").otherwise("review_path")
