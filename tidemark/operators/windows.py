"""Window operators over ordered samples.

Every function takes a frame with ``keys`` (the series), ``t`` (a dense index from 0) and a
value column, and works on partitions of ``keys``; there is no unpartitioned window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys) -> Window:
    return Window.partitionBy(*keys).orderBy("t")


def whole(keys) -> Window:
    return Window.partitionBy(*keys)


def prefix_sum(value: Column, keys) -> Column:
    return F.sum(value).over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0))


def sliding_rms(df: DataFrame, length: int, keys, value: str = "value", to: str = "rms") -> DataFrame:
    """Root mean square of x[t .. t + length) by differences of prefix sums; starts without a whole window go."""
    w = ordered(keys)
    sums = df.withColumn("__s", F.coalesce(F.sum(F.col(value) * F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    upto = F.lead(F.col("__s") + F.col(value) * F.col(value), length - 1).over(w)
    rows = sums.withColumn("__u", upto).where("__u is not null")
    return rows.withColumn(to, F.sqrt(F.greatest(F.lit(0.0), F.col("__u") - F.col("__s")) / length)).drop("__s", "__u")


def sliding_peak(df: DataFrame, length: int, keys, value: str = "value", to: str = "peak") -> DataFrame:
    """Largest absolute value of x[t .. t + length): the maximum of a running block maximum from both sides.

    Blocks of ``length`` samples; the suffix maximum of the first block touched and the
    prefix maximum of the next give the answer, so the cost does not grow with ``length``.
    """
    block = F.floor(F.col("t") / length)
    rows = df.withColumn("__b", block).withColumn("__a", F.abs(value))
    inner = Window.partitionBy(*keys, "__b").orderBy("t")
    rows = rows.withColumn("__to", F.max("__a").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__from", F.max("__a").over(inner.rowsBetween(0, Window.unboundedFollowing)))
    end = F.lead("__to", length - 1).over(ordered(keys))
    return rows.withColumn(to, F.greatest("__from", end)).withColumn("__end", end).where("__end is not null").drop("__b", "__a", "__to", "__from", "__end")


def kernel(taps: int, last: float = 1.5) -> list[float]:
    """A normal bell over [-1.5, last], normalised to sum 1."""
    at = [-1.5 + (last + 1.5) * k / (taps - 1) for k in range(taps)] if taps > 1 else [-1.5]
    bell = [math.exp(-x * x / 2) for x in at]
    return [b / sum(bell) for b in bell]


def fir(value: Column, weights: Column, keys, taps: int) -> Column:
    """Convolution with ``weights`` (an array column), valid part: y[t] = sum of x[t + j] w[taps - 1 - j]; null where x ends."""
    frame = ordered(keys).rowsBetween(0, taps - 1)
    got = F.collect_list(value).over(frame)
    total = F.aggregate(F.zip_with(got, F.reverse(weights), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.count(value).over(frame) == taps, total)


def min_max(value: Column, low, high, keys) -> Column:
    """Values scaled to [low, high] over the series; a constant goes to ``low``."""
    w = whole(keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, (value - lo) / F.when(hi > lo, hi - lo) * (high - low) + low).otherwise(low)


def roll(df: DataFrame, shift: int, keys, value: str = "value", to: str = "rolled") -> DataFrame:
    """y[t] = x[(t - shift) mod n]."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    moved = df.join(n, list(keys)).select(*keys, F.pmod(F.col("t") + shift, F.col("__n")).alias("t"), F.col(value).alias(to))
    return df.join(moved, [*keys, "t"])


def reverse(df: DataFrame, keys, value: str = "value", to: str = "reversed") -> DataFrame:
    """y[t] = x[n - 1 - t]."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    moved = df.join(n, list(keys)).select(*keys, (F.col("__n") - 1 - F.col("t")).alias("t"), F.col(value).alias(to))
    return df.join(moved, [*keys, "t"])


def resample(df: DataFrame, points: int, keys, value: str = "value", to: str = "resampled") -> DataFrame:
    """Linear interpolation at ``points`` places spread evenly from the first to the last sample."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    grid = n.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("t"))
    at = F.col("t") * (F.col("__n") - 1) / F.lit(float(max(1, points - 1)))
    grid = grid.withColumn("__at", at).withColumn("__lo", F.floor("__at").cast("long")).withColumn("__hi", F.least(F.col("__lo") + 1, F.col("__n") - 1))
    left = df.select(*keys, F.col("t").alias("__lo"), F.col(value).alias("__x"))
    right = df.select(*keys, F.col("t").alias("__hi"), F.col(value).alias("__y"))
    out = grid.join(left, [*keys, "__lo"]).join(right, [*keys, "__hi"])
    return out.select(*keys, "t", (F.col("__x") + (F.col("__at") - F.col("__lo")) * (F.col("__y") - F.col("__x"))).alias(to))


def anchored(value: Column, reference: Column, i: Column, length: Column, window) -> Column:
    """``value`` plus the straight line that makes its ends meet the reference's."""
    w = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(reference - value).over(w)
    last = F.last(reference - value).over(w)
    alpha = i / F.greatest(length - 1.0, F.lit(1.0))
    return F.when(length <= 1, reference).otherwise(value + (1.0 - alpha) * first + alpha * last)


def free_slots(df: DataFrame, length: int, keys, busy: str = "busy") -> DataFrame:
    """Starts t at which no sample of [t, t + length) is busy."""
    frame = ordered(keys).rowsBetween(0, length - 1)
    rows = df.withColumn("__sum", F.sum(busy).over(frame)).withColumn("__n", F.count(busy).over(frame))
    return rows.where((F.col("__sum") == 0) & (F.col("__n") == length)).drop("__sum", "__n")


def context_range(value: Column, width: int, keys) -> Column:
    """max - min over the samples from t - width // 2 to t + width // 2."""
    frame = ordered(keys).rowsBetween(-(width // 2), width // 2)
    return F.max(value).over(frame) - F.min(value).over(frame)
