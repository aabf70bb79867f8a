"""Arithmetic, comparison and masking over columns where NULL is a missing pixel.

NaN never stays in a frame: results that have no value become NULL, so aggregates and comparisons skip them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(x) -> Column:
    """A Column of doubles from a Column, column name or number."""
    return (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)).cast("double")


def nn(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(F.isnan(x), None).otherwise(x)


def add(a, b) -> Column:
    return nn(col(a) + col(b))


def subtract(a, b) -> Column:
    return nn(col(a) - col(b))


def multiply(a, b) -> Column:
    return nn(col(a) * col(b))


def divide(a, b) -> Column:
    """x / 0 is infinite with the sign of x; 0 / 0 is missing."""
    a, b = col(a), col(b)
    return nn(F.when(b == 0, F.when(a == 0, None).otherwise(F.signum(a) * INF)).otherwise(F.try_divide(a, b)))


def ratio(a, b) -> Column:
    """a / b, missing where b is 0."""
    return nn(F.try_divide(col(a), col(b)))


def floor_divide(a, b) -> Column:
    return nn(F.floor(ratio(a, b)).cast("double"))


def modulo(a, b) -> Column:
    """The remainder with the divisor's sign."""
    return nn(col(a) - col(b) * F.floor(ratio(a, b)))


def power(a, b) -> Column:
    return nn(F.pow(col(a), col(b)))


def log(x) -> Column:
    x = col(x)
    return F.when(x == 0, -INF).when(x > 0, F.ln(x))


def log10(x) -> Column:
    x = col(x)
    return F.when(x == 0, -INF).when(x > 0, F.log10(x))


def sqrt(x) -> Column:
    x = col(x)
    return F.when(x >= 0, F.sqrt(x))


def exp(x) -> Column:
    """e to the x by the C library, whose last digit is right but for one value in about a hundred; the JVM's is off more often."""

    def one(v: float) -> float:
        try:
            return math.exp(v)
        except OverflowError:
            return INF

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one).astype("float64")

    return nn(run(col(x)))


def _plain(f):
    return lambda x: nn(f(col(x)).cast("double"))


#: Functions of one band by name; round is half to even.
UNARY = {
    "abs": _plain(F.abs), "sqrt": sqrt, "log": log, "log10": log10, "exp": exp, "sin": _plain(F.sin), "cos": _plain(F.cos),
    "tan": _plain(F.tan), "floor": _plain(F.floor), "ceil": _plain(F.ceil), "round": _plain(F.rint),
}


def compare(a, op: str, b) -> Column:
    """1.0 or 0.0; with a missing side 0.0, but 1.0 for ``!=``."""
    a, b = col(a), col(b)
    made = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b, "!=": a != b}[op]
    return F.coalesce(made.cast("double"), F.lit(1.0 if op == "!=" else 0.0))


def clamp(x, low, high) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def both(f, a, b) -> Column:
    """f(a, b), missing where either is."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), f(a, b))


def update_mask(x, mask) -> Column:
    """Missing where the mask is 0; a missing mask keeps the pixel."""
    return F.when(col(mask) == 0, None).otherwise(col(x))


def where(x, condition, value) -> Column:
    """value where the condition is not 0 or missing."""
    c = col(condition)
    return F.when(c.isNull() | (c != 0), col(value)).otherwise(col(x))


def unmask(x, value) -> Column:
    """Missing becomes value; infinities become the largest single-precision numbers."""
    x = col(x)
    top = 3.4028234663852886e38
    return F.coalesce(F.when(x == INF, top).when(x == -INF, -top).otherwise(x), col(value))


def normalized_difference(a, b) -> Column:
    return ratio(col(a) - col(b), col(a) + col(b))
