"""Evidence values: struct of frequency and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truth(frequency, confidence) -> Column:
    one = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(one(frequency).alias("frequency"), one(confidence).alias("confidence"))


def expectation(t: Column) -> Column:
    return t["confidence"] * (t["frequency"] - 0.5) + 0.5


def revision(a: Column, b: Column) -> Column:
    """Evidence of both, weighted by confidence; <0.5, 0> where neither has any."""
    w1 = a["confidence"] * (1 - b["confidence"])
    w2 = b["confidence"] * (1 - a["confidence"])
    f = F.least(F.lit(1.0), (w1 * a["frequency"] + w2 * b["frequency"]) / (w1 + w2))
    c = F.least(F.lit(0.99), (a["confidence"] + b["confidence"]) / (1 + a["confidence"] + b["confidence"]))
    return F.when(w1 + w2 < 0.001, truth(0.5, 0.0)).otherwise(truth(f, c))
