"""Blocked moments of a stream: counts, sums and sums of squares merge, so a watermark and a window are all it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_moments(events: DataFrame, time: str, by: list[str], value: str, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window_start, by, n, mean, variance) per window; rows later than ``delay`` are dropped. Works on streams and on tables.

    NULL and NaN values are left out; variance is NULL where n < 2.
    """
    x = events.withWatermark(time, delay).filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    g = x.groupBy(F.window(time, length).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n", "mean", F.when(F.col("n") > 1, F.col("variance")).alias("variance"))
