"""A streaming drift monitor: an extension, the batch operators have no streaming semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(stream: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n, mean and deviation of ``value`` by tumbling window and group; later rows than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).select(F.col("window.start").alias("start"), group, "n", "mean", "sd")
