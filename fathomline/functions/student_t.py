"""Two-sided quantiles of Student's t distribution as a column expression.

For up to ``TABLE_SIZE`` degrees of freedom the quantile is solved on the driver from the finite
trigonometric form of the distribution function (Abramowitz & Stegun 26.7.3-26.7.4) and put into the
plan as an array literal. Above that the asymptotic expansion 26.7.5 is used, whose error at the end of
the table is below 1e-10.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column, functions as F

TABLE_SIZE = 200


def central_probability(t: float, df: int) -> float:
    """P(-t < T < t) for a whole number of degrees of freedom."""
    theta = math.atan(t / math.sqrt(df))
    cos2 = math.cos(theta) ** 2
    if df % 2:
        term, total = math.cos(theta), 0.0
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= cos2 * 2 * k / (2 * k + 1)
        return 2 / math.pi * (theta + math.sin(theta) * total)
    term, total = 1.0, 0.0
    for k in range(1, df // 2 + 1):
        total += term
        term *= cos2 * (2 * k - 1) / (2 * k)
    return math.sin(theta) * total


@lru_cache(maxsize=8)
def t_table(confidence: float = 0.95) -> tuple[float, ...]:
    """Quantiles for 1 .. ``TABLE_SIZE`` degrees of freedom, by bisection."""

    def solve(df: int) -> float:
        low, high = 0.0, 1.0
        while central_probability(high, df) < confidence:
            high *= 2
        for _ in range(80):
            mid = (low + high) / 2
            if central_probability(mid, df) < confidence:
                low = mid
            else:
                high = mid
        return (low + high) / 2

    return tuple(solve(df) for df in range(1, TABLE_SIZE + 1))


def expansion_coefficients(confidence: float = 0.95) -> tuple[float, ...]:
    """Coefficients of 1, 1/df, 1/df^2, 1/df^3, 1/df^4 in the expansion around the normal quantile."""
    x = NormalDist().inv_cdf((1 + confidence) / 2)
    return (
        x,
        (x**3 + x) / 4,
        (5 * x**5 + 16 * x**3 + 3 * x) / 96,
        (3 * x**7 + 19 * x**5 + 17 * x**3 - 15 * x) / 384,
        (79 * x**9 + 776 * x**7 + 1482 * x**5 - 1920 * x**3 - 945 * x) / 92160,
    )


def t_quantile(df: Column, confidence: float = 0.95) -> Column:
    """The t with P(-t < T < t) = ``confidence``; null below one degree of freedom."""
    table = F.array(*[F.lit(t) for t in t_table(confidence)])
    inv = F.try_divide(F.lit(1.0), df.cast("double"))
    tail = F.lit(0.0)
    for c in reversed(expansion_coefficients(confidence)):
        tail = tail * inv + F.lit(c)
    return F.when(df.between(1, TABLE_SIZE), F.try_element_at(table, df.cast("int"))).when(df > TABLE_SIZE, tail)
