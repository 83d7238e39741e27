"""Existing data as series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def indexed_csv(spark: SparkSession, path: str, column: str | int, n: int) -> DataFrame:
    """The first ``n`` rows (t, value) of one column, by name or number from 0, in file order.

    Values are cast to double; a value that is no number, a missing column or a file that is
    too short raises ValueError.
    """
    raw = spark.read.csv(path, header=True)
    if isinstance(column, int):
        if not 0 <= column < len(raw.columns):
            raise ValueError(f"{path} has no column {column}")
        column = raw.columns[column]
    elif column not in raw.columns:
        raise ValueError(f"{path} has no column {column!r}")
    value = F.col(f"`{column}`")
    # file order, without a single partition: places within partitions, after the rows of the partitions before
    rows = raw.select(value.alias("raw"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("id"))
    sizes = rows.groupBy("p").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.select("p", "first", before.alias("before")), "p")
    rows = rows.select((F.col("before") + F.col("id") - F.col("first")).alias("t"), "raw").where(F.col("t") < n)
    number = F.expr("try_cast(raw as double)")
    seen = rows.agg(F.count(F.lit(1)), F.sum((F.col("raw").isNotNull() & number.isNull()).cast("int"))).first()
    if seen[0] < n:
        raise ValueError(f"{path} has {seen[0]} rows, {n} are needed")
    if seen[1]:
        raise ValueError(f"{path}: {column} holds values that are no numbers")
    return rows.select("t", number.alias("value"))


def event_channels(events: DataFrame) -> DataFrame:
    """The events table as a series: one channel for each event type, t by time and then identifier."""
    t = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    kinds = events.select("event_type").distinct().withColumn("channel", F.row_number().over(Window.orderBy("event_type")) - 1)
    return events.select("event_type", "value", t.cast("long").alias("t")).join(kinds, "event_type").select("channel", "t", "value")


def user_series(events: DataFrame) -> DataFrame:
    """The events table as one series for each user: t by time and then identifier."""
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events.select(F.col("user_id").alias("series"), t.cast("long").alias("t"), "value")


def daily_sums(lineitem: DataFrame) -> DataFrame:
    """Sums of extended prices by return flag and day of shipping, days numbered from the first."""
    day = lineitem.groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("value"))
    first = day.agg(F.min("day").alias("first"))
    return day.crossJoin(F.broadcast(first)).select(F.col("l_returnflag").alias("channel"), F.datediff("day", "first").cast("long").alias("t"), "value")


def vector_series(embeddings: DataFrame) -> DataFrame:
    """Each vector as a series of its components."""
    return embeddings.select(F.col("vec_id").alias("series"), F.posexplode("embedding").alias("t", "value")).select("series", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"))
