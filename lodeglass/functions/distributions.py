"""Tail probability of the chi-squared distribution, which Spark has no expression for."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Steps of the series or the continued fraction at most; both stop long before that at the sizes below.
STEPS = 10_000
#: From this many degrees of freedom on the tail is that of a normal variable with two terms of correction (Temme's uniform expansion),
#: which agrees with the exact terms to nine digits there, and to more beyond; those take ever more steps and lose digits.
UNIFORM_FROM = 1_000_000


def chi2_tail(x: float | None, df: int | None) -> float | None:
    """P(X >= x): the upper regularised gamma function of df / 2 at x / 2, in a bounded number of steps."""
    if x is None or df is None or df <= 0 or math.isnan(x):
        return None
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    if df >= UNIFORM_FROM:
        return _uniform_tail(df / 2.0, x / df - 1.0)
    a, half = df / 2.0, x / 2.0
    front = math.exp(a * math.log(half) - half - math.lgamma(a))
    if half < a + 1.0:
        # lower part by its power series
        term = total = 1.0 / a
        for n in range(1, STEPS):
            term *= half / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, min(1.0, 1.0 - front * total))
    # upper part by its continued fraction, evaluated forwards
    tiny = 1e-300
    b = half + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for n in range(1, STEPS):
        step = -n * (n - a)
        b += 2.0
        d = 1.0 / ((step * d + b) or tiny)
        c = (b + step / c) or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return max(0.0, min(1.0, front * value))


def _uniform_tail(a: float, m: float) -> float:
    """The upper regularised gamma function of a large ``a`` at a * (1 + m)."""
    if abs(m) < 0.01:
        log_gap = sum((-m) ** k / k for k in range(2, 14))  # m - log(1 + m) without its cancellation
    else:
        log_gap = m - math.log1p(m)
    eta = math.copysign(math.sqrt(2.0 * log_gap), m)
    if abs(eta) < 0.05:
        first = -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864 + eta**4 / 2835
        second = -1 / 540 - eta / 288 + eta**2 / 378
    else:
        first = 1 / m - 1 / eta
        second = 1 / eta**3 - 1 / m**3 - 1 / m**2 - 1 / (12 * m)
    correction = math.exp(-a * log_gap) / math.sqrt(2 * math.pi * a) * (first + second / a)
    return max(0.0, min(1.0, 0.5 * math.erfc(eta * math.sqrt(a / 2)) + correction))


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [chi2_tail(None if pd.isna(v) else float(v), None if pd.isna(d) else int(d)) for v, d in zip(x, df)],
        dtype="float64",
    )
