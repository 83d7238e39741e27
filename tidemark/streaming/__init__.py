"""Closed-form series as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import oscillators as osc
from ..functions.rng import fast_uniform
from ..operators import series
from ..sources import config as cfg


def live(spark: SparkSession, config, seed: int = 42, rows_per_second: int = 100, source: DataFrame | None = None) -> DataFrame:
    """An unbounded stream of samples (timestamp, series, channel, t, value) of closed-form channels.

    The index comes from the rate source (or a stream with timestamp and value); every sample
    is a function of it, so the stream has no state and survives restarts unchanged.
    """
    specs = [
        series.spec_row(bo, ts["name"], "live", c, 0, ts["length"], seed)
        for ts in cfg.normalise(cfg.load(config))
        for c, bo in enumerate(ts["channels"])
        if bo["kind"] in osc.CLOSED
    ]
    ticks = source if source is not None else spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    ticks = ticks.select("timestamp", F.col("value").alias("t"))
    frame = spark.createDataFrame(specs, series.SPEC)
    rows = ticks.crossJoin(F.broadcast(frame))  # one row for each channel of the configuration
    value = osc.closed_form(F.col("t"), series.params(rows), kinds={s[4] for s in specs})
    noise = (fast_uniform(F.col("seed"), F.col("channel"), F.col("t")) - 0.5) * F.sqrt(F.lit(12.0)) * F.col("variance") * F.col("amplitude")
    return rows.select("timestamp", "series", "channel", "t", (value + noise + F.col("offset")).alias("value"))


def windowed(samples: DataFrame, delay: str = "10 seconds", width: str = "1 minute") -> DataFrame:
    """Mean, deviation and extremes of each channel in event-time windows, late rows dropped after ``delay``."""
    window = F.window("timestamp", width)
    return (
        samples.withWatermark("timestamp", delay)
        .groupBy(window, "series", "channel")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
