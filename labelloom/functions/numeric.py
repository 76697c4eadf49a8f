"""Distribution tails for report tables (one row per system or comparison).

Spark has no error function, incomplete beta or t quantile.  These helpers run as Arrow UDFs
over report-sized rows, never over the corpus.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300

    def coefficient(n: int) -> float:
        m = n // 2
        if n % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    value, c, d = 1.0, 1.0, 0.0
    for n in range(1, 5000):
        step = coefficient(n)
        d = 1.0 + step * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + step / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return 1.0 / value


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(b, a, 1.0 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    return math.exp(log_front) / a * _beta_fraction(a, b, x)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if math.isinf(t):
        return 0.0
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile (p >= 0.5) of Student's t by bisection on the tail."""
    target, lo, hi = 2.0 * (1.0 - p), 0.0, 1.0
    while t_two_sided(hi, df) > target:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if t_two_sided(mid, df) > target else (lo, mid)
    return (lo + hi) / 2.0


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; null in, null out."""

    @F.pandas_udf("double")
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        pairs = zip(ts, dfs)
        return pd.Series(
            [None if pd.isna(a) or pd.isna(b) else t_two_sided(a, b) for a, b in pairs],
            dtype="float64",
        )

    return p(t.cast("double"), df.cast("double"))


def t_critical(level: float, df: Column) -> Column:
    """t such that P(|T| <= t) = level; null when df < 1."""

    @F.pandas_udf("double")
    def crit(dfs: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(d) or d < 1 else t_quantile(0.5 + level / 2.0, d) for d in dfs],
            dtype="float64",
        )

    return crit(df.cast("double"))


def chi2_pvalue_1df(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""

    @F.pandas_udf("double")
    def p(xs: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(v) else math.erfc(math.sqrt(v / 2.0)) for v in xs], dtype="float64"
        )

    return p(x.cast("double"))


# The closures above call module functions: ship those by value, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
