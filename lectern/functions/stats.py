"""Numeric functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_improvement(base: Column, new: Column) -> Column:
    """In percent of ``base``; 0 where that isn't positive."""
    return F.when(base > 0, (new - base) / base * 100).otherwise(F.lit(0.0))


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade.cast("double")) - 1


def discount(rank: Column) -> Column:
    return F.log2(rank.cast("double") + 1)


def t_test_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite series in cos**2 of atan(|t| / sqrt(df)).

    Null where t or df is null, or df < 1.
    """
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    odd = df % 2 == 1
    m = F.when(odd, F.floor((df - 3) / 2)).otherwise(F.floor(df / 2) - 1).cast("int")
    cos2 = F.pow(F.cos(theta), F.lit(2.0))
    steps = F.when(m >= 1, F.sequence(F.lit(1), F.greatest(m, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("acc"), F.lit(1.0).alias("term"))

    def add(s: Column, j: Column) -> Column:
        ratio = F.when(odd, 2.0 * j / (2.0 * j + 1.0)).otherwise((2.0 * j - 1.0) / (2.0 * j))
        term = s["term"] * ratio * cos2
        return F.struct((s["acc"] + term).alias("acc"), term.alias("term"))

    series = F.aggregate(steps, start, add, lambda s: s["acc"])
    a_odd = F.lit(2 / math.pi) * (theta + F.when(df > 1, F.sin(theta) * F.cos(theta) * series).otherwise(F.lit(0.0)))
    a = F.when(odd, a_odd).otherwise(F.sin(theta) * series)
    return F.when(t.isNotNull() & ~F.isnan(t) & (df >= 1), F.greatest(F.lit(0.0), F.lit(1.0) - a))
