"""Running composites over a stream of observations (an extension; the batch operators have no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reducer import Reducer


def running_composite(observations: DataFrame, value: str, keys: list[str], time: str = "ts", window: str = "1 day", late: str = "2 days", reducers: list[Reducer] | None = None) -> DataFrame:
    """(start, keys..., one column a reducer) for each tumbling window; state of windows older than the watermark is dropped."""
    reducers = reducers or [Reducer.mean(), Reducer.count()]
    timed = observations.withColumn(time, F.col(time).cast("timestamp"))
    marked = timed.withWatermark(time, late) if timed.isStreaming else timed
    grouped = marked.groupBy(F.window(time, window).alias("__w"), *keys)
    return grouped.agg(*[r.column(value).alias(r.name) for r in reducers]).select(F.col("__w.start").alias("start"), *keys, *[r.name for r in reducers])
