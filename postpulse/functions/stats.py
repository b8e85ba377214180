"""Two-sided Student-t p-value as a column expression.

Both forms below run on result rows only (one per fitted series) and stay in
the JVM.  See Abramowitz & Stegun 26.7.3-4 and 26.5.4.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _product(first: int, last: Column, step: int, factor) -> Column:
    """Product of ``factor(k)`` for k = first, first+step, ... up to ``last``."""
    ks = F.when(last >= first, F.sequence(F.lit(first), last, F.lit(step)))
    return F.aggregate(F.coalesce(ks, F.array().cast("array<int>")), F.lit(1.0), lambda acc, k: acc * factor(k))


def _central_sum(t: Column, df: Column) -> Column:
    """P(|T| < |t|): the finite sums for odd and even degrees of freedom."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos, sin = F.cos(theta), F.sin(theta)
    state = lambda total, term: F.struct(total.alias("total"), term.alias("term"))

    def series(first: int, start: Column) -> Column:
        # term_k = term_{k-2} * (k-1)/k * cos^2, k running in steps of two
        ks = F.when(df - 2 >= first, F.sequence(F.lit(first), df - 2, F.lit(2)))
        return F.aggregate(
            F.coalesce(ks, F.array().cast("array<int>")),
            state(start, start),
            lambda acc, k: state(
                acc["total"] + acc["term"] * (k - 1) / k * cos * cos,
                acc["term"] * (k - 1) / k * cos * cos,
            ),
            lambda acc: acc["total"],
        )

    even = sin * series(2, F.lit(1.0))
    odd_tail = F.when(df == 1, F.lit(0.0)).otherwise(sin * series(3, cos))
    odd = F.lit(2.0 / math.pi) * (theta + odd_tail)
    return F.when(df % 2 == 0, even).otherwise(odd)


def _tail_series(t: Column, df: Column) -> Column:
    """P(|T| > |t|) as a sum of positive terms, exact in relative terms for tiny values."""
    dof = df.cast("double")
    x = dof / (dof + t * t)
    a = dof / 2
    # Gamma(a + 1/2) / Gamma(a), by the recursion in steps of one in a
    odd_ratio = F.lit(1 / math.sqrt(math.pi)) * _product(1, df - 2, 2, lambda k: (k + 1) / k)
    even_ratio = F.lit(math.sqrt(math.pi) / 2) * _product(2, df - 2, 2, lambda k: (k + 1) / k)
    ratio = F.when(df % 2 == 0, even_ratio).otherwise(odd_ratio)
    scale = F.pow(x, a) * F.sqrt(1 - x) * ratio / F.lit(math.sqrt(math.pi)) / a
    # ratio of neighbours is below x, so this many terms reach double precision
    terms = F.ceil(F.lit(40.0) / (1 - x)).cast("int")
    state = lambda total, term: F.struct(total.alias("total"), term.alias("term"))
    total = F.aggregate(
        F.sequence(F.lit(0), terms),
        state(F.lit(1.0), F.lit(1.0)),
        lambda acc, n: state(
            acc["total"] + acc["term"] * (a + 0.5 + n) / (a + 1 + n) * x,
            acc["term"] * (a + 0.5 + n) / (a + 1 + n) * x,
        ),
        lambda acc: acc["total"],
    )
    return scale * total


def student_t_pvalue(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for integer ``df`` >= 1; null where ``t`` or ``df`` is null."""
    df = df.cast("int")
    usable = t.isNotNull() & (df >= 1)
    tail = 1 - _central_sum(t, df)
    return F.when(usable & (t * t > 10.0), _tail_series(t, df)).when(usable, F.greatest(tail, F.lit(0.0)))
