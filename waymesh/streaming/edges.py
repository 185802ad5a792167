"""Counts along edges kept up to date from a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjacency_stream(edges: DataFrame, watermark: str | None = None, time_col: str = "ts") -> DataFrame:
    """``i, j, v`` of a streaming ``i, j`` (and a time, if late edges are to be dropped after *watermark*).

    The state has an entry for each pair; with a watermark and event-time windows of a day it is bounded, and
    the windows' counts add up to the adjacency.
    """
    if watermark is None:
        return edges.groupBy("i", "j").agg(F.count("*").alias("v"))
    timed = edges.withWatermark(time_col, watermark)
    return timed.groupBy(F.window(time_col, "1 day").alias("day"), "i", "j").agg(F.count("*").alias("v")).select(F.col("day.start").alias("day"), "i", "j", "v")


def merged(parts: DataFrame) -> DataFrame:
    """The adjacency from counts of several windows or batches."""
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))
