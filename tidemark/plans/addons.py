"""Add-ons: called with the samples of an engine (``process``) and once at its end (``finalize``)."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import series, stats


class AddOn:
    """Base of add-ons; ``data`` is shared by all calls of one add-on."""

    def __init__(self):
        self.data: dict = {}

    def process(self, samples: DataFrame, engine) -> DataFrame:
        return samples

    def finalize(self, engine) -> None:
        return None


#: The columns of the metadata table, in their order.
COLUMNS = (
    "collection_name", "dataset_name", "train_path", "test_path", "dataset_type", "datetime_index", "split_at", "train_type", "train_is_normal", "input_type", "length",
    "dimensions", "contamination", "num_anomalies", "min_anomaly_length", "median_anomaly_length", "max_anomaly_length", "mean", "stddev", "trend", "stationarity", "period_size",
)


class Metadata(AddOn):
    """One row for each series and kind of training (``COLUMNS``); statistics are those of the test split. Written as CSV if ``output`` is given."""

    def __init__(self, output: str | None = None, collection: str = "tidemark"):
        super().__init__()
        self.output, self.collection = output, collection

    def process(self, samples: DataFrame, engine) -> DataFrame:
        keys = ["series"]
        schema = "series string, split string, anomaly int, channel int, start long, end long"
        labels = engine.spark.createDataFrame(engine.labels(), schema).where("split = 'test'")
        specs = engine.spark.createDataFrame(engine._specs()[0], series.SPEC).where("depth = 0 and split = 'test'")
        found = stats.metadata(samples.where("split = 'test'"), labels, keys).join(stats.period_sizes(specs, keys), keys, "left")
        rows = []
        for ts in engine.series:
            trend = (series.flat_trends(ts["channels"][0]) or [{}])[0].get("kind")
            kinds = [("unsupervised", None)] + [("supervised", "train_anomaly")] * ts["supervised"] + [("semi-supervised", "train_no_anomaly")] * ts["semi_supervised"]
            rows += [(ts["name"], f"{ts['name']}.{kind}", split and f"{ts['name']}/{split}", f"{ts['name']}/test", kind, kind != "supervised", trend) for kind, split in kinds]
        names = engine.spark.createDataFrame(rows, "series string, dataset_name string, train_path string, test_path string, train_type string, train_is_normal boolean, trend string")
        out = names.join(found, keys)
        out = out.withColumns({
            "collection_name": F.lit(self.collection), "dataset_type": F.lit("synthetic"), "datetime_index": F.lit(False), "split_at": F.lit(None).cast("long"),
            "input_type": F.when(F.col("dimensions") == 1, "univariate").otherwise("multivariate"), "stationarity": F.lit(None).cast("string"),
        })
        self.data["table"] = out.select(*COLUMNS)
        return samples

    def finalize(self, engine) -> None:
        if self.output is not None:
            self.data["table"].write.mode("overwrite").csv(self.output, header=True)


BUILTIN = {"metadata": Metadata}


def resolve(name) -> AddOn:
    """An add-on by built-in name, dotted path of a class, class or instance."""
    if isinstance(name, AddOn):
        return name
    if isinstance(name, str):
        if name in BUILTIN:
            name = BUILTIN[name]
        else:
            module, _, attribute = name.rpartition(".")
            if not module:
                raise ValueError(f"unknown add-on {name!r}")
            name = getattr(importlib.import_module(module), attribute)
    if not (isinstance(name, type) and issubclass(name, AddOn)):
        raise ValueError(f"{name!r} is no add-on")
    return name()
