"""Statistics of series, instances, splits and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: More than the steps of a 4096th of an octave between 1 and any other double.
_STEPS = 5_000_000


def five(column: str, prefix: str):
    """mean, population deviation, minimum and maximum under a prefix."""
    return [F.avg(column).alias(f"{prefix}_mean"), F.stddev_pop(column).alias(f"{prefix}_std"), F.min(column).alias(f"{prefix}_min"), F.max(column).alias(f"{prefix}_max")]


def instance_summary(events: DataFrame, keys) -> DataFrame:
    """For each instance the number of segments and the statistics of their lengths."""
    rows = events.withColumn("length", F.col("end") - F.col("start"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"), *five("length", "length"), F.median("length").alias("length_median"))


def split_statistics(instances: DataFrame, keys, values=("target_density", "achieved_density", "segments")) -> DataFrame:
    """For each split the number of instances and the statistics of their values."""
    return instances.groupBy(*keys).agg(F.count(F.lit(1)).alias("instances"), *[x for v in values for x in five(v, v)])


def rollup_statistics(instances: DataFrame, variant: str = "variant", split: str = "split", value: str = "segments") -> DataFrame:
    """Statistics by variant and split, by variant, and of all, in one pass; null marks a level's total."""
    return instances.rollup(variant, split).agg(F.count(F.lit(1)).alias("instances"), *five(value, value), F.median(value).alias(f"{value}_median"))


def metadata(samples: DataFrame, labels: DataFrame, keys) -> DataFrame:
    """One row for each series: length, dimensions, contamination, anomaly counts and lengths, mean and mean deviation.

    Contamination is the sum of the anomalies' lengths over the length, overlaps counted
    twice. The deviation is the mean over time of the population deviation across channels.
    """
    at = samples.groupBy(*keys, "t").agg(F.stddev_pop("value").alias("sd"), F.sum("value").alias("s"), F.count("value").alias("c"))
    size = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"), F.max("c").alias("dimensions"), (F.sum("s") / F.sum("c")).alias("mean"), F.avg("sd").alias("stddev"))
    rows = labels.withColumn("l", F.col("end") - F.col("start"))
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_anomalies"), F.min("l").alias("min_anomaly_length"), F.median("l").alias("median_anomaly_length"), F.max("l").alias("max_anomaly_length"), F.sum("l").alias("covered"))
    out = size.join(found, list(keys), "left").withColumn("contamination", F.coalesce("covered", F.lit(0)) / F.col("length"))
    return out.withColumn("num_anomalies", F.coalesce("num_anomalies", F.lit(0).cast("long"))).drop("covered")


def period_sizes(channels: DataFrame, keys) -> DataFrame:
    """The median period of each series' channels (kind, frequency, periodicity, complexity, n); null where none has one."""
    f = F.col("frequency")
    size = (
        F.when(F.col("kind").isin("sine", "cosine", "ecg", "square", "sawtooth"), F.floor(100.0 / f))
        .when(F.col("kind") == "dirichlet", F.floor(100.0 / f) * F.when(F.col("periodicity") % 2 == 0, 2).otherwise(1))
        .when(F.col("kind") == "mls", F.pow(F.lit(2.0), F.col("complexity")) - 1)
        .when(F.col("kind") == "random-mode-jump", F.floor(F.col("n") / f))
    )
    return channels.withColumn("period", size.cast("double")).groupBy(*keys).agg(F.median("period").alias("period_size"))


def quantiles(df: DataFrame, column: str, q: float, keys) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    return df.groupBy(*keys).agg(F.percentile(column, q).alias("threshold"))


def large_quantiles(df: DataFrame, column: str, q: float, keys) -> DataFrame:
    """The same quantiles of groups that no single task can hold, from two passes.

    The first counts values by steps of a 4096th of an octave, the second sorts the values of the
    step or two that hold the wanted ranks; a group whose values all lie in one step has its
    distinct values sorted by one task, which spills. Nulls count for nothing.
    """
    x = F.col(column).cast("double")
    size = F.floor(F.log2(F.least(F.abs(x), F.lit(1.7976931348623157e308))) * 4096)
    step = F.when(F.isnan(x), 3 * _STEPS).when(x > 0, _STEPS + size).when(x < 0, -_STEPS - size).otherwise(0)
    rows = df.where(x.isNotNull()).select(*keys, x.alias("__x"), step.cast("long").alias("__step"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("__step").rowsBetween(Window.unboundedPreceding, 0)
    steps = rows.groupBy(*keys, "__step").agg(F.count(F.lit(1)).alias("__c"))
    steps = steps.select("*", (F.sum("__c").over(upto) - F.col("__c")).alias("__before"), ((F.sum("__c").over(group) - 1) * F.lit(float(q))).alias("__at"))
    steps = steps.withColumn("__low", F.floor("__at")).withColumn("__high", F.ceil("__at")).where((F.col("__before") <= F.col("__high")) & (F.col("__before") + F.col("__c") > F.col("__low")))
    near = rows.join(F.broadcast(steps.drop("__c")), [*keys, "__step"])
    near = near.groupBy(*keys, "__step", "__before", "__at", "__low", "__high", "__x").agg(F.count(F.lit(1)).alias("__c"))
    within = Window.partitionBy(*keys, "__step").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__upto", F.col("__before") + F.sum("__c").over(within))
    a, b = (F.min(F.when(F.col("__upto") > F.col(k), F.col("__x"))) for k in ("__low", "__high"))
    ends = near.groupBy(*keys, "__at", "__low", "__high").agg(a.alias("__a"), b.alias("__b"))
    line = (F.col("__high") - F.col("__at")) * F.col("__a") + (F.col("__at") - F.col("__low")) * F.col("__b")
    return ends.select(*keys, F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(line).alias("threshold"))


def distinct_first(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def pairwise_correlation(samples: DataFrame, keys) -> DataFrame:
    """Correlations of all pairs of channels of a series and their mean; channels are few."""
    a = samples.select(*keys, "t", F.col("channel").alias("a"), F.col("value").alias("x"))
    b = samples.select(*keys, "t", F.col("channel").alias("b"), F.col("value").alias("y"))
    return a.join(b, [*keys, "t"]).where("a < b").groupBy(*keys, "a", "b").agg(F.corr("x", "y").alias("corr"))
