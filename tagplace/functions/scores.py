"""Formulas of the models, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def idf(total, count: Column) -> Column:
    """ln(total / count), unsmoothed: negative for a tag more frequent than rows."""
    return F.log(F.lit(total).cast("double") / count) if not isinstance(total, Column) else F.log(total.cast("double") / count)


def log_prior(n: Column, rows: Column, classes: Column, lam: float) -> Column:
    return F.log(n + lam) - F.log(rows + classes * lam)


def log_denom(weight: Column, vocabulary: Column, lam: float) -> Column:
    return F.log(weight + vocabulary * lam)


def log_weight(weight: Column, lam: float) -> Column:
    return F.log(weight + lam)


def posterior(score: Column, *by: str) -> Column:
    """Softmax of the scores of a group."""
    w = W.partitionBy(*by)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def normalise(p: Column, *by: str) -> Column:
    """Share of the group's sum; a sum of zero counts as one."""
    total = F.sum(p).over(W.partitionBy(*by))
    return p / F.when(total == 0, F.lit(1.0)).otherwise(total)
