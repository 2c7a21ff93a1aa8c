"""Edge support over event time from a stream of moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_support(moves: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, u, v, support, length)`` per window of event time ``ts``; moves later than ``late`` are dropped."""
    w = moves.withWatermark("ts", late).groupBy(F.window("ts", window), "u", "v")
    return w.agg(F.count("*").alias("support"), F.sum("step").alias("length")).select(F.col("window.start").alias("start"), "u", "v", "support", "length")
