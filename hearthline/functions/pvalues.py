"""p-values of correlation tests as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs (Student t); NULL for fewer than three pairs.

    With whole degrees of freedom the share of a t distribution within ``±t`` is a finite sum.  Here the sine of its
    angle is ``|r|``, so the terms are powers of ``1 - r²``; there are half as many as pairs.  The result has an
    absolute error of about 1e-13, so smaller values may come back as zero.
    """
    freedom = n.cast("long") - 2
    odd = F.pmod(freedom, F.lit(2))
    # Rounding may leave a correlation a little beyond one.
    sine = F.least(F.lit(1.0), F.abs(r))
    squared = 1.0 - sine * sine
    last = ((freedom - 2 - odd) / 2).cast("long")
    steps = F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * squared * (2 * k - 1 + odd) / (2 * k + odd)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    total = F.aggregate(steps, start, add, lambda state: state["sum"])
    total = F.when(freedom == 1, F.lit(0.0)).otherwise(total)
    even_share = sine * total
    odd_share = (F.asin(sine) + sine * F.sqrt(squared) * total) * (2.0 / math.pi)
    within = F.when(odd == 1, odd_share).otherwise(even_share)
    # A perfect correlation has no sum to round.
    tail = F.when(sine >= 1.0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - within))
    return F.when((n >= 3) & r.isNotNull() & ~F.isnan(r), tail)
