"""Tail probabilities of test statistics. They are asked for once per table, so plain numbers in an Arrow function do."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fraction(terms, start: float) -> float:
    """A continued fraction start + a1 / (b1 + a2 / (b2 + ...)), by Lentz's method; terms yields (a, b)."""
    tiny = 1e-300
    f = c = start or tiny
    d = 0.0
    for a, b in terms:
        d = 1 / (b + a * d or tiny)
        c = b + a / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    return front / _fraction(((-k * (k - a), b + 2 * k) for k in range(1, 10_000)), b)


def beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def terms():
        for m in range(10_000):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return front / _fraction(terms(), 1.0)


def student_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_part(dof / 2, 0.5, dof / (dof + t * t))


def chi2_p_value(chi2: Column, dof: Column) -> Column:
    """P(X >= chi2) of the chi-square distribution; null where either is null or dof is 0."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([gamma_tail(d / 2, v / 2) if pd.notna(v) and pd.notna(d) and d > 0 else None for v, d in zip(x, k)], dtype="float64")

    return tail(chi2.cast("double"), dof.cast("double"))


def correlation_p_value(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a rank correlation by Student's t with n - 2 degrees of freedom; null below 3 rows."""

    @F.pandas_udf("double")
    def tail(r: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for v, m in zip(r, k):
            if pd.isna(v) or pd.isna(m) or m < 3:
                out.append(None)
            else:
                out.append(0.0 if abs(v) >= 1 else student_p(v * math.sqrt((m - 2) / (1 - v * v)), m - 2))
        return pd.Series(out, dtype="float64")

    return tail(rho.cast("double"), n.cast("double"))
