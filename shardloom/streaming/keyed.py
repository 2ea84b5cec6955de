"""Keyed aggregation over a stream: an extension, for sources that keep growing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def combine_windows(stream: DataFrame, time: str, key: str, width: str, late: str, **aggregates: Column) -> DataFrame:
    """key, start and aggregates of tumbling windows; rows later than `late` behind the latest time are left out.

    Works on a batch too, where nothing is late.
    """
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    found = rows.groupBy(F.window(time, width).alias("w"), F.col(key).alias("key")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return found.select("key", F.col("w.start").alias("start"), *aggregates)
