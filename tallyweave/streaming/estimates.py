"""Weighted estimators over an event stream, by event-time window.

An extension: means, shares and effective sample sizes are sums, so the batch estimators run unchanged
in a streaming aggregation; a watermark bounds the state and drops what comes too late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import estimators as E


def windowed_estimates(events: DataFrame, time: str, group: str, value: str, weight: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per window and group: weighted mean, usable rows, effective n. ``events`` may be a stream or a table."""
    t = events.withWatermark(time, late) if events.isStreaming else events
    out = t.groupBy(F.window(time, window).alias("window"), F.col(group)).agg(
        E.weighted_mean(value, weight).alias("mean"),
        E.n_usable(weight, value).alias("n_rows"),
        E.effective_n(weight, F.col(value).isNotNull()).alias("n_eff"),
    )
    return out.select(F.col("window.start").alias("window_start"), group, "mean", "n_rows", "n_eff")


def write_estimates(estimates: DataFrame, path: str, checkpoint: str):
    """Append closed windows as Parquet; restarts go on from the checkpoint."""
    return estimates.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
