"""Quantiles of Student's t, by bisection of the distribution's continued fraction."""

from __future__ import annotations

import math


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(tiny, 1 - (a + b) * x / (a + 1), key=abs)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / max(tiny, 1 + top * d, key=abs)
            c = max(tiny, 1 + top / c, key=abs)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, for x from 0 to 1."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """The chance of a value over t >= 0."""
    return 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(tail: float, df: float) -> float:
    """The t that is passed with the chance `tail`, under one half."""
    low, high = 0.0, 1.0
    while t_tail(high, df) > tail:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_tail(middle, df) > tail else (low, middle)
    return (low + high) / 2


def esd_critical(n: int, i: int, alpha: float) -> float:
    """The i-th critical value (from 1) of the generalised extreme studentized deviate of n values; infinite where too few are left."""
    df = n - i - 1
    if df < 1:
        return math.inf
    t = t_quantile(alpha / (2 * (n - i + 1)), df)
    return (n - i) * t / math.sqrt((df + t * t) * (n - i + 1))
