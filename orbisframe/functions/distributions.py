"""Tail probabilities without a statistics library."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_p(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for k in range(1, 400):
        for term in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def sample_size(effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Observations in each of two groups that find a standardised difference."""
    z = NormalDist().inv_cdf
    return math.ceil(2 * ((z(1 - alpha / 2) + z(power)) / effect) ** 2)
