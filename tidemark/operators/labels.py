"""Labels, effective support of events and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Times that share one list of events.
SPAN = 4096


def point_labels(grid: DataFrame, events: DataFrame, keys, few: bool = False) -> DataFrame:
    """The grid's rows (keys, t and others) with label 1 where an event (keys, start, end) covers t.

    Events are listed by key and span of times, and looked up by equality. ``few``: the events are known to be
    few enough to be sent to all tasks, so that no sample moves.
    """
    spans = events.where(F.col("end") > F.col("start")).select(*keys, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor((F.col("end") - 1) / SPAN))).alias("__span"))
    spans = spans.groupBy(*keys, "__span").agg(F.collect_list(F.struct("start", "end")).alias("__events"))
    rows = grid.withColumn("__span", F.floor(F.col("t") / SPAN)).join(F.broadcast(spans) if few else spans, [*keys, "__span"], "left")
    hit = F.exists("__events", lambda x: (F.col("t") >= x["start"]) & (F.col("t") < x["end"]))
    return rows.select(*grid.columns, F.coalesce(hit, F.lit(False)).cast("int").alias("label"))


def effective_support(samples: DataFrame, events: DataFrame, keys, eps: float = 0.05, relative: bool = True, min_length: int = 1) -> DataFrame:
    """Events with start and end moved to where the effect |after - before| exceeds eps.

    eps is a share of the event's largest effect or absolute. Without any such sample the
    whole window stays. If what is left is shorter than ``min_length``, the stretch of that
    length inside the window with the largest total effect is taken, the first on ties.
    """
    ids = [*keys, "event"]
    rows = samples.join(events.select(*keys, "event", "start", "end"), list(keys)).where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    rows = rows.withColumn("delta", F.abs(F.col("after") - F.col("before")))
    floor = F.max("delta").over(Window.partitionBy(*ids)) * eps if relative else F.lit(eps)
    rows = rows.withColumn("active", F.col("delta") > floor)
    span = rows.groupBy(*ids).agg(F.first("start").alias("s"), F.first("end").alias("e"), F.min(F.when(F.col("active"), F.col("t"))).alias("a"), F.max(F.when(F.col("active"), F.col("t"))).alias("b"))
    span = span.select(*ids, "s", "e", F.coalesce("a", "s").alias("a"), F.coalesce(F.col("b") + 1, F.col("e")).alias("b"))
    if min_length <= 1:
        return span.select(*ids, F.col("a").alias("start"), F.col("b").alias("end"), F.col("s").alias("source_start"), F.col("e").alias("source_end"))
    size = F.least(F.lit(min_length), F.col("e") - F.col("s"))
    # totals of every stretch by differences of prefix sums
    order = Window.partitionBy(*ids).orderBy("t")
    sums = rows.select(*ids, "t", F.sum("delta").over(order).alias("upto"), "delta").join(span.select(*ids, "s", "e"), ids)
    ends = sums.select(*ids, (F.col("t") - size + 1).alias("t"), F.col("upto").alias("last"))
    starts = sums.select(*ids, "t", "s", "e", (F.col("upto") - F.col("delta")).alias("before_"))
    score = starts.join(ends, [*ids, "t"]).withColumn("score", F.round(F.col("last") - F.col("before_"), 9))
    best = score.withColumn("rank", F.row_number().over(Window.partitionBy(*ids).orderBy(F.desc("score"), "t"))).where("rank = 1").select(*ids, F.col("t").alias("w"))
    short = (F.col("b") - F.col("a")) < size
    out = span.join(best, ids)
    return out.select(*ids, F.when(short, F.col("w")).otherwise(F.col("a")).alias("start"), F.when(short, F.col("w") + size).otherwise(F.col("b")).alias("end"), F.col("s").alias("source_start"), F.col("e").alias("source_end"))


def mismatches(labels: DataFrame, events: DataFrame, keys) -> DataFrame:
    """Samples whose label differs from what the events say: keys, t, label, expected."""
    rebuilt = point_labels(labels.select(*keys, "t"), events, keys).withColumnRenamed("label", "expected")
    return labels.join(rebuilt, [*keys, "t"]).where(F.col("label") != F.col("expected"))


def density(labels: DataFrame, keys) -> DataFrame:
    """For each series the share of times at which any channel is labelled."""
    any_ = labels.groupBy(*keys, "t").agg(F.max("label").alias("any"))
    return any_.groupBy(*keys).agg(F.avg("any").alias("density"))


def check_density(achieved: DataFrame, low: float, high: float, tolerance: float) -> DataFrame:
    """Adds whether the density lies in the range, give or take the tolerance."""
    return achieved.withColumn("ok", F.col("density").between(low - tolerance, high + tolerance))
