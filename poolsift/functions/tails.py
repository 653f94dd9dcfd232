"""Tail probabilities of the t and F distributions as column expressions.

Both are one ratio of integrals of cos^(d2-1)·sin^(d1-1), so no gamma function
is needed. The mass sits within a few 1/sqrt(d2) of its peak; the upper limit
follows it, which keeps the fixed number of panels exact enough for logs with
millions of rows.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

PANELS = 2000


def _simpson(lower: Column, upper: Column, d1: Column, d2: Column) -> Column:
    step = (upper - lower) / F.lit(float(PANELS))

    def add(acc, i):
        angle = lower + i * step
        weight = (
            F.when((i == 0) | (i == PANELS), F.lit(1.0))
            .when(i % 2 == 1, F.lit(4.0))
            .otherwise(F.lit(2.0))
        )
        height = F.pow(F.greatest(F.cos(angle), F.lit(0.0)), d2 - 1) * F.pow(F.sin(angle), d1 - 1)
        return acc + weight * height

    points = F.sequence(F.lit(0), F.lit(PANELS))
    return F.aggregate(points, F.lit(0.0), add) * step / F.lit(3.0)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F(d1, d2) > f); null without degrees of freedom."""
    d2 = F.when(d2 > 0, d2)
    d1, d2 = d1.cast("double"), d2.cast("double")
    upper = F.least(F.lit(1.5707963267948966), (F.sqrt(d1) + F.lit(12.0)) / F.sqrt(d2))
    lower = F.least(F.atan(F.sqrt(d1 * f / d2)), upper)
    return _simpson(lower, upper, d1, d2) / _simpson(F.lit(0.0), upper, d1, d2)


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided P(|t(df)| > |t|)."""
    return f_tail(t * t, F.lit(1.0), df)
