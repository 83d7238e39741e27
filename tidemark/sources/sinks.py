"""Writing series: CSV by split, overview and metadata documents, partitioned Parquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(samples: DataFrame, path: str, overwrite: bool = True) -> None:
    """All samples, partitioned by series and split."""
    samples.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("series", "split").parquet(path)


def write_csv(wide: DataFrame, path: str, digits: int | None = None, overwrite: bool = True) -> None:
    """A wide table in order of time with a header; values with a fixed number of digits if asked for."""
    if digits is not None:
        wide = wide.select(*[F.format_string(f"%.{digits}f", F.col(f"`{c}`")).alias(c) if c.startswith("value-") else F.col(f"`{c}`") for c in wide.columns])
    # one file for a series and split is the format; range partitions keep larger ones in order over several files
    wide.sort("timestamp").write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def write_text(spark, text: str, path: str) -> None:
    """A small document through Spark's writers, so that any file system will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def overview(engine) -> dict:
    """The configuration with the seed and a number for each series."""
    series = [{**raw, "generation-id": k} for k, raw in enumerate(engine.raw["timeseries"])]
    return {"seed": engine.seed, "timeseries": series}


def write_engine(engine, samples: DataFrame, output: str) -> None:
    """<output>/<series>/<split> as CSV for every series and split, and the overview."""
    from ..plans.engine import splits_of

    samples = samples.cache()
    for ts in engine.series:
        for split in splits_of(ts):
            rows = samples.where((F.col("series") == ts["name"]) & (F.col("split") == split))
            values = [F.max(F.when(F.col("channel") == c, F.col("value"))).alias(f"value-{c}") for c in range(len(ts["channels"]))]
            wide = rows.groupBy(F.col("t").alias("timestamp")).agg(*values, F.max("is_anomaly").alias("is_anomaly"))
            write_csv(wide, f"{output}/{ts['name']}/{split}")
    samples.unpersist()
    try:
        import yaml

        text = yaml.safe_dump(overview(engine), sort_keys=False)
    except ImportError:
        text = json.dumps(overview(engine), indent=2)
    write_text(engine.spark, text, f"{output}/overview")
