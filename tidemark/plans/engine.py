"""Series from configurations.

``Engine.samples()`` is one lazy frame for all series, splits and channels: base,
noise, trend, offset, value and label of every sample. ``Engine.wide(name, split)`` is the
table of one series with a column for each channel.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formula as fx
from ..functions import oscillators as osc
from ..functions.rng import draw, drawing
from ..operators import anomalies as an
from ..operators import series
from ..operators import windows as win
from ..sources import config as cfg
from . import placement

#: Splits in their order, and their file names.
SPLITS = {"test": "test", "train_no_anomaly": "train_no_anomaly", "train_anomaly": "train_anomaly"}


def splits_of(ts: dict) -> list[str]:
    return ["test", *(["train_no_anomaly"] if ts["semi_supervised"] else []), *(["train_anomaly"] if ts["supervised"] else [])]


def _drawn(method):
    """The method's draws are the engine's kind of draws."""

    @functools.wraps(method)
    def run(self, *args, **options):
        with drawing(self.fast):
            return method(self, *args, **options)

    return run


class Engine:
    """All series of a configuration.

    ``inputs`` maps names to frames (t, value), or (key, t, value) for many channels in one, for custom-input channels, which name one by
    ``input`` (and ``key``) or read files by input-timeseries-path-test / -train. An input with fewer samples than its
    series' length is an error. ``add_ons`` (objects, classes, built-in names or dotted paths) are called with every
    series' frame (``process``) and once at the end (``finalize``). ``parallelism``: partitions of a shuffle, if given.
    ``fast``: draws of samples are hashes that only Spark can repeat, instead of MD5; positions are the same.
    """

    def __init__(self, spark: SparkSession, config, seed: int = 42, only: str | None = None, inputs: dict | None = None, compat: bool = False, skip_errors: bool = False, add_ons=(), parallelism: int | None = None, fast: bool = False):
        from . import addons

        self.spark, self.seed, self.compat, self.fast = spark, seed, compat, fast
        if parallelism:
            spark.conf.set("spark.sql.shuffle.partitions", str(parallelism))
        self.raw = cfg.load(config)
        self.series = cfg.normalise(self.raw, only, skip_errors)
        self.inputs = inputs or {}
        self.add_ons = [addons.resolve(a) for a in add_ons]

    @classmethod
    def from_dict(cls, spark, config: dict, **options):
        return cls(spark, config, **options)

    @classmethod
    def from_yaml(cls, spark, path, **options):
        return cls(spark, path, **options)

    from_json = from_yaml

    def remove(self, which) -> None:
        """Drops series by name or by a predicate on names."""
        test = which if callable(which) else lambda name: name == which
        self.series = [s for s in self.series if not test(s["name"])]

    # --- specification ---------------------------------------------------------------

    def _specs(self):
        specs, custom, formulas = [], {}, []
        for ts in self.series:
            for split in splits_of(ts):
                for c, bo in enumerate(ts["channels"]):
                    for depth, x in enumerate([bo, *series.flat_trends(bo)]):
                        row = series.spec_row(x, ts["name"], split, c, depth, ts["length"], self.seed)
                        if x["kind"] == "formula":
                            formulas.append((row, x["formula"]))
                            continue
                        if x["kind"] == "custom-input":
                            custom[row[:4]] = self._input(x, split, ts["length"])
                        specs.append(row)
        return specs, custom, formulas

    def _input(self, bo: dict, split: str, n: int):
        """What a custom-input channel reads: (name of a frame, key), or a file's frame by itself."""
        from ..sources import tables

        if "input" in bo:
            if bo["input"] not in self.inputs:
                raise cfg.ConfigError(f"custom-input: there is no input {bo['input']!r}")
            return bo["input"], bo.get("key")
        path = bo.get("input-timeseries-path-train") if split != "test" else bo.get("input-timeseries-path-test")
        if not path:
            raise cfg.ConfigError(f"custom-input: no path for the split {split}")
        return tables.indexed_csv(self.spark, path, bo.get("use-column-train" if split != "test" else "use-column-test", 0), n)

    def _custom(self, specs: list, custom: dict) -> DataFrame:
        """Samples of the custom-input channels: parameters, t, base. Each input is read once and meets its channels by key."""
        known: dict = {}
        for row in specs:
            if row[:4] in custom:
                own = custom[row[:4]]
                known.setdefault(own[0] if isinstance(own, tuple) else id(own), (self.inputs[own[0]] if isinstance(own, tuple) else own, []))[1].append(((own[1] if isinstance(own, tuple) else None), row))
        out = None
        for frame, uses in known.values():
            keyed = "key" in frame.columns
            rows = frame.select(F.col("key").cast("string").alias("__in") if keyed else F.lit("").alias("__in"), F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("base"))
            wanted = [(str(k) if keyed else "", *row) for k, row in uses]
            spec = self.spark.createDataFrame(wanted, f"__in string, {series.SPEC}")
            # one row for each channel of the configuration
            part = rows.join(F.broadcast(spec), "__in").where("t < n")
            sizes = {r[0]: r[1] for r in rows.where(F.col("__in").isin(sorted({w[0] for w in wanted}))).groupBy("__in").agg(F.count(F.lit(1))).collect()}
            for k, *row in wanted:
                if sizes.get(k, 0) < row[5]:
                    raise ValueError(f"the custom input of channel {row[2]} of {row[0]} has {sizes.get(k, 0)} samples, {row[5]} are needed")
            part = part.select(*series.NAMES, "t", "base")
            out = part if out is None else out.unionByName(part)
        return out

    def windows(self) -> list[tuple]:
        """All windows, one row for each kind of each anomaly (see ``operators.anomalies``)."""
        out = []
        for ts in self.series:
            for split in splits_of(ts):
                if split == "train_no_anomaly":
                    continue
                order = 0
                for k, (a, (s, e)) in enumerate(zip(ts["anomalies"], placement.place(ts, split, self.seed, self.compat))):
                    for kind in a["kinds"]:
                        u = draw(self.seed, ts["name"], split, "kind", order)
                        out.append(an.window_row(ts["name"], split, k, order, a["channel"], ts["channels"][a["channel"]], kind, s, e, a["creeping"], u, self.seed))
                        order += 1
        return out

    def labels(self) -> list[tuple]:
        """(series, split, anomaly, channel, start, end) of every anomaly."""
        out = []
        for ts in self.series:
            for split in splits_of(ts):
                if split != "train_no_anomaly":
                    for k, (a, (s, e)) in enumerate(zip(ts["anomalies"], placement.place(ts, split, self.seed, self.compat))):
                        out.append((ts["name"], split, k, a["channel"], s, min(e, ts["length"])))
        return out

    # --- frames -----------------------------------------------------------------------

    @_drawn
    def clean(self) -> DataFrame:
        """Samples before anomalies: parameters, t, base, noise, trend, offset."""
        specs, custom, formulas = self._specs()
        rows = series.samples(self.spark, [r for r in specs if r[:4] not in custom])
        if custom:
            given = self._custom(specs, custom)
            rows = given if len(custom) == len(specs) else rows.unionByName(given)
        own = rows.where("depth = 0")
        if formulas:
            own = own.unionByName(self._formulas(own, formulas))
        own = own.withColumn("noise", series.noise_column())
        if any(r[3] for r in specs):
            keys = ["series", "split", "channel", "t"]
            trend = rows.where("depth > 0").groupBy(*keys).agg(F.sum("base").alias("trend"))
            own = own.join(trend, keys, "left").withColumn("trend", F.coalesce("trend", F.lit(0.0)))
        else:
            own = own.withColumn("trend", F.lit(0.0))
        return own.select(*series.NAMES, "t", "base", "noise", "trend")

    def _formulas(self, rows: DataFrame, formulas) -> DataFrame:
        """Formula channels, in the order of their numbers, from the channels before them."""
        parts = None
        for row, formula in formulas:
            name, split, channel = row[0], row[1], row[2]
            before = rows if parts is None else rows.unionByName(parts)
            needed = sorted(fx.channels(formula))
            one = before.where((F.col("series") == name) & (F.col("split") == split) & F.col("channel").isin(needed))
            wide = one.groupBy("series", "split", "t").agg(*[F.max(F.when(F.col("channel") == c, F.col("base"))).alias(f"c{c}") for c in needed])
            value = fx.compile_formula(formula, lambda c: F.col(f"c{c}"), win.whole(["series", "split"]))
            spec = self.spark.createDataFrame([row], series.SPEC)
            part = wide.select("series", "split", "t", value.cast("double").alias("base")).join(spec, ["series", "split"]).select(*series.NAMES, "t", "base")
            parts = part if parts is None else parts.unionByName(part)
        return parts

    @_drawn
    def samples(self) -> DataFrame:
        """All samples: series, split, channel, t, base, noise, trend, offset, value, is_anomaly."""
        rows, wins = self.clean(), self.windows()
        if wins:
            frame = self.spark.createDataFrame(wins, an.WINDOWS)
            bases = {ts["channels"][w[2]]["kind"] for ts in self.series for w in wins if w[0] == ts["name"]}
            trends = {w[an.TREND][0] for w in wins if w[an.TREND]}
            rows = an.inject(rows, frame, {w[5] for w in wins}, bases, trends, self._alternatives(wins), self._walks(wins), few=len(wins) <= an.FEW)
        value = F.col("base") + F.col("noise") + F.col("trend") + F.col("offset")
        out = rows.select("series", "split", "channel", "t", "base", "noise", "trend", "offset", value.alias("value"))
        return self._labelled(out)

    def _labelled(self, rows: DataFrame) -> DataFrame:
        labels = self.labels()
        if not labels:
            return rows.withColumn("is_anomaly", F.lit(0))
        spans = self.spark.createDataFrame(labels, "series string, split string, anomaly int, channel int, s long, e long")
        spans = spans.groupBy("series", "split").agg(F.collect_list(F.struct("s", "e")).alias("__spans"))
        hit = F.exists("__spans", lambda w: (F.col("t") >= w["s"]) & (F.col("t") < w["e"]))
        return rows.join(F.broadcast(spans) if len(labels) <= an.FEW else spans, ["series", "split"], "left").withColumn("is_anomaly", F.coalesce(hit, F.lit(False)).cast("int")).drop("__spans")

    def _alternatives(self, wins) -> DataFrame | None:
        """Regenerated cylinder-bell-funnel series for pattern and variance kinds."""
        names = [c.split(" ")[0].strip("`") for c in an.WINDOWS.split(", ")]
        parts = []
        for w in wins:
            p = dict(zip(names, w))
            ts = next(s for s in self.series if s["name"] == p["series"])
            bo = ts["channels"][p["channel"]]
            if bo["kind"] != "cylinder-bell-funnel" or p["what"] not in ("pattern", "variance"):
                continue
            row = dict(zip(series.NAMES, series.spec_row(bo, p["series"], p["split"], p["channel"], 0, ts["length"], self.seed)))
            if p["what"] == "pattern":
                row["var_len"] *= p["cbf_factor"]
            elif p["target"]:
                row["variance"] = p["target"]
            spec = self.spark.createDataFrame([tuple(row[c] for c in series.NAMES)], series.SPEC)
            alt = series.cylinder_bell_funnel(spec, f"cbf-{p['order']}", noise=False)
            own = F.when(F.col("variance") > 0, F.col("variance") * series.normal(F.col("seed"), F.lit(f"cbf-{p['order']}-noise"), F.col("channel"), F.col("depth"), F.col("t"))).otherwise(0.0)
            parts.append(alt.where((F.col("t") >= p["s"]) & (F.col("t") < p["e"])).select("series", "split", F.lit(p["order"]).alias("order"), "t", (F.col("base") + own).alias("alt")))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def _walks(self, wins) -> DataFrame | None:
        """Local trends of sequential kinds."""
        specs = []
        for ts in self.series:
            for split in splits_of(ts):
                if split == "train_no_anomaly":
                    continue
                order = 0
                for a, (s, e) in zip(ts["anomalies"], placement.place(ts, split, self.seed, self.compat)):
                    for kind in a["kinds"]:
                        bo = kind.get("oscillation") if kind["kind"] == "trend" else None
                        if bo and bo["kind"] not in osc.CLOSED:
                            specs.append(series.spec_row(bo, ts["name"], split, order, 100, e - s, self.seed))
                        order += 1
        if not specs:
            return None
        rows = series.samples(self.spark, specs)
        return rows.select("series", "split", F.col("channel").alias("order"), F.col("t").alias("i"), F.col("base").alias("walk"))

    def wide(self, name: str, split: str = "test") -> DataFrame:
        """timestamp, value-0 .. value-k, is_anomaly of one series."""
        ts = next(s for s in self.series if s["name"] == name)
        rows = self.samples().where((F.col("series") == name) & (F.col("split") == split))
        values = [F.max(F.when(F.col("channel") == c, F.col("value"))).alias(f"value-{c}") for c in range(len(ts["channels"]))]
        return rows.groupBy(F.col("t").alias("timestamp")).agg(*values, F.max("is_anomaly").cast("byte").alias("is_anomaly"))

    def generate(self, output=None) -> DataFrame:
        """The samples after all add-ons; written below ``output`` if it is given."""
        out = self.samples()
        for a in self.add_ons:
            out = a.process(out, self)
        if output is not None:
            from ..sources import sinks

            sinks.write_engine(self, out, output)
        for a in self.add_ons:
            a.finalize(self)
        return out
