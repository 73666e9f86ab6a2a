"""The weekly aggregate over a stream of chart entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_means(entries: DataFrame, value: str, weight: str, ts: str = "ts", late: str = "14 days", start: str = "0 days") -> DataFrame:
    """(week_start, mean, weight) over a streaming or batch frame; start "0 days" gives weeks from Thursday, and entries later than `late` are dropped when streaming."""
    weeks = entries.withWatermark(ts, late).groupBy(F.window(ts, "7 days", startTime=start))
    got = weeks.agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))
    return got.select(F.col("window.start").alias("week_start"), "mean", "weight")
