"""Reducers: aggregate Columns that skip missing values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Reducer:
    """A name and a function from a column to its aggregate; ``order`` is what first, last and mosaics go by."""

    def __init__(self, name: str, make: Callable[[Column, Column | None], Column]):
        self.name, self.make = name, make

    def column(self, x, order=None) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        return self.make(x, F.col(order) if isinstance(order, str) else order)

    @staticmethod
    def _simple(name: str, f) -> Reducer:
        return Reducer(name, lambda x, _: f(x))

    @staticmethod
    def mean() -> Reducer:
        return Reducer._simple("mean", F.avg)

    @staticmethod
    def median() -> Reducer:
        return Reducer._simple("median", F.median)

    @staticmethod
    def min() -> Reducer:
        return Reducer._simple("min", F.min)

    @staticmethod
    def max() -> Reducer:
        return Reducer._simple("max", F.max)

    @staticmethod
    def sum() -> Reducer:
        """0 where nothing is there."""
        return Reducer._simple("sum", lambda x: F.coalesce(F.sum(x), F.lit(0.0)))

    @staticmethod
    def stdDev() -> Reducer:
        return Reducer._simple("stdDev", F.stddev_pop)

    @staticmethod
    def variance() -> Reducer:
        return Reducer._simple("variance", F.var_pop)

    @staticmethod
    def count() -> Reducer:
        return Reducer._simple("count", F.count)

    @staticmethod
    def mode() -> Reducer:
        """The smallest of the most frequent."""
        return Reducer._simple("mode", lambda x: F.mode(x, True))

    @staticmethod
    def percentile(p) -> Reducer:
        """Linear interpolation; an array, also for one p."""
        ps = [p] if isinstance(p, (int, float)) else list(p)
        return Reducer._simple("percentile", lambda x: F.percentile(x, F.array(*[F.lit(q / 100) for q in ps])))

    @staticmethod
    def minMax() -> Reducer:
        return Reducer._simple("minMax", lambda x: F.struct(F.min(x).alias("min"), F.max(x).alias("max")))

    @staticmethod
    def first() -> Reducer:
        return Reducer("first", lambda x, order: F.min_by(F.struct(x.alias("v")), order)["v"])

    @staticmethod
    def last() -> Reducer:
        return Reducer("last", lambda x, order: F.max_by(F.struct(x.alias("v")), order)["v"])


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n): equal widths from the least to the largest value, the last bin closed; empty bins have rows."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).filter("lo is not null")
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.width_bucket(x, F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins)).cast("int") - 1
    counts = df.filter(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # ends is one row
    every = ends.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
