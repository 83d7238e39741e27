"""Datasets: a grid of oscillations and anomalies as paired clean and anomalous series.

The plan of all instances (parameters and segments) is drawn on the driver; its size is
bounded by the configuration. All instances together are one engine, so samples of any
number of them are one lazy frame.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import oscillators as osc
from ..functions.rng import draw, seed_of
from ..operators import labels as lb
from ..operators import planner as pl
from ..operators import stats as st
from ..runtime import cut, ship
from ..sources import config as cfg
from .engine import Engine

#: What a configuration leaves open.
DEFAULTS = {
    "generator": {"master_seed": 42, "on_variant_failure": "skip"},
    "dataset": {"length": 10000, "channels": 5, "splits": ["train", "val", "test"], "instances_per_split": 5},
    "anomaly_policy": {
        "density_range": [0.05, 0.10], "density_tolerance": 0.002, "segment_count_range": [20, 50], "overlap_policy": "global", "support_label_mode": "strict_segment",
        "support_eps_mode": "relative", "support_eps_value": 0.05, "min_effective_label_length_non_extremum": 1, "special_anomaly_policies": {}, "min_segment_length_by_anomaly": {}, "segment_planner": {},
    },
    "variants": {
        "base_oscillations": [], "anomaly_types": [], "skip_base_oscillations": [], "skip_anomaly_types": [], "disabled_anomaly_types": [], "profiles_per_pair": 1,
        "base_parameter_policy": "random_per_instance", "anomaly_parameter_policy": "fixed_per_variant", "base_oscillation_overrides": {}, "anomaly_overrides": {}, "base_channel_overrides": {}, "variant_overrides": {},
        "base_channel_correlation": {"shared_noise_weight": 0.0}, "split_phase_shift": {"enabled": False},
    },
}
#: Parameter ranges of the kinds.
ANOMALY_TEMPLATES = {
    "amplitude": {"amplitude_factor": [1.5, 2.5]}, "extremum": {"min": False, "local": False}, "frequency": {"frequency_factor": [1.5, 2.5]}, "mean": {"offset": [0.5, 1.5]},
    "pattern": {"sinusoid_k": [5.0, 10.0]}, "pattern-shift": {"shift_by": 3, "transition_window": 5}, "platform": {"value": [-0.5, 0.5]},
    "trend": {"oscillation": {"kind": "sine", "frequency": 5.0}}, "variance": {"variance": [0.3, 0.8]}, "mode-correlation": {},
}


class Dataset:
    """All instances of a dataset configuration."""

    def __init__(self, spark: SparkSession, config):
        self.spark = spark
        raw = cfg.load(config)
        self.conf = copy.deepcopy(DEFAULTS)
        for section, values in self.conf.items():
            values.update({k: raw[k] for k in values if k in raw})
            values.update(raw.get(section) or {})
        self.seed = self.conf["generator"]["master_seed"]
        self._check()
        self.variants, self.skipped = self._variants()
        self.instances = self._plan()

    def _check(self) -> None:
        d, p = self.conf["dataset"], self.conf["anomaly_policy"]
        if min(d["length"], d["channels"], d["instances_per_split"]) < 1 or not d["splits"] or len(set(d["splits"])) < len(d["splits"]):
            raise cfg.ConfigError("dataset: length, channels and instances are positive, splits are distinct and there is one at least")
        lo, hi = p["density_range"]
        if not 0 < lo <= hi < 1:
            raise cfg.ConfigError("anomaly_policy.density_range: inside (0, 1)")
        if not 1 <= p["segment_count_range"][0] <= p["segment_count_range"][1] <= d["length"]:
            raise cfg.ConfigError("anomaly_policy.segment_count_range: from 1 to the length")
        if not 0 <= self.conf["variants"]["base_channel_correlation"].get("shared_noise_weight", 0.0) <= 1:
            raise cfg.ConfigError("variants.base_channel_correlation.shared_noise_weight: inside [0, 1]")

    def _variants(self):
        v = self.conf["variants"]
        bases = [b for b in cfg.KINDS if (not v["base_oscillations"] or b in v["base_oscillations"]) and b not in v["skip_base_oscillations"] and b not in ("formula", "custom-input")]
        anomalies = [a for a in cfg.ANOMALIES if (not v["anomaly_types"] or a in v["anomaly_types"]) and a not in v["skip_anomaly_types"]]
        used, skipped = [], []
        for b in sorted(bases):
            for a in sorted(anomalies):
                for k in range(v["profiles_per_pair"]):
                    who = f"{b}__{a}__p{k:02d}"
                    if a in v["disabled_anomaly_types"]:
                        skipped.append((who, "anomaly disabled"))
                    elif not cfg.compatible(a, b):
                        skipped.append((who, "incompatible"))
                    else:
                        used.append((who, b, a))
        return used, skipped

    def cascade(self, variant: str, base: str, anomaly: str) -> tuple[dict, dict]:
        """Templates of the base's and the anomaly's parameters: defaults, then by kind, pair and variant."""
        v = self.conf["variants"]
        own = v["variant_overrides"].get(variant, {})
        b = {**v["base_oscillation_overrides"].get(base, {}), **own.get("base_parameters", {})}
        pair = v["anomaly_overrides"].get(f"{base}__{anomaly}", {})
        a = {**ANOMALY_TEMPLATES[anomaly], **v["anomaly_overrides"].get(anomaly, {}), **pair, **own.get("anomaly_parameters", {})}
        return b, a

    def _scope(self, policy: str, variant: str, split: str, k: int, segment: int | None = None):
        """What a draw depends on: base parameters of an instance are the same in all splits."""
        if policy == "fixed_per_variant":
            return (variant,)
        return (variant, split, k) if segment is None else (variant, split, k, segment)

    def _plan(self) -> list[dict]:
        d = self.conf["dataset"]
        drafts = []
        for variant, base, anomaly in self.variants:
            b, a = self.cascade(variant, base, anomaly)
            own = self.conf["variants"]["variant_overrides"].get(variant, {}).get("anomaly_policy", {})
            special = {**self.conf["anomaly_policy"], **self.conf["anomaly_policy"]["special_anomaly_policies"].get(anomaly, {}), **own}
            planner = pl.resolve(self.conf["anomaly_policy"]["segment_planner"], anomaly, self.conf["anomaly_policy"]["special_anomaly_policies"].get(anomaly), own.get("segment_planner"))
            for split in d["splits"]:
                for k in range(d["instances_per_split"]):
                    drafts.append(self._draft(variant, base, anomaly, split, k, b, a, special, planner))
        strong = [x for x in drafts if x["planner"]["planner"] == "energy_aware_segments" or x["anomaly"] == "trend" and x["planner"]["planner"] == "trend_parameter_aware_segments"]
        planned = self._planned_on_samples(strong) if strong else {}
        out = []
        for x in drafts:
            try:
                out.append(self._instance(x, planned.get(x["instance"])))
            except ValueError as e:
                if self.conf["generator"]["on_variant_failure"] == "fail_fast":
                    raise
                self.skipped.append((x["variant"], str(e)))
        bad = {s[0] for s in self.skipped}
        return [x for x in out if x["variant"] not in bad]

    def _draft(self, variant, base, anomaly, split, k, b, a, special, planner) -> dict:
        """An instance's channels, density and templates; its segments are planned later."""
        d, v = self.conf["dataset"], self.conf["variants"]
        n, seed = d["length"], seed_of(self.seed, variant, split, k)
        scope = (variant,) if v["base_parameter_policy"] == "fixed_per_variant" else (variant, k)
        channels = []
        for c in range(d["channels"]):
            template = {**b, **v["base_channel_overrides"].get(base, {}).get(str(c), {})}
            channels.append({"kind": base, **{x.replace("_", "-"): (t if x == "polynomial" and not v.get("realise_lists") else pl.realised(t, self.seed, "base", x, *scope, c)) for x, t in template.items()}})
            shift = v["split_phase_shift"]
            if shift.get("enabled"):
                channels[-1]["phase"] = (channels[-1].get("phase", 0.0) + shift["values"][split]) % shift.get("phase_modulo", 6.283185307179586)
        lo, hi = special["density_range"]
        name = f"{variant}/{split}/{k:03d}"
        return {"instance": name, "variant": variant, "split": split, "base": base, "anomaly": anomaly, "k": k, "seed": seed, "density": lo + (hi - lo) * draw(seed, "density"), "templates": a, "special": special, "planner": planner, "series": {"name": name, "length": n, "base-oscillations": channels, "anomalies": []}}

    def _parameters(self, x: dict, j: int) -> dict:
        """The drawn parameters of an instance's segment j."""
        policy = self.conf["variants"]["anomaly_parameter_policy"]
        who = self._scope(policy, x["variant"], x["split"], x["k"], j if policy == "random_per_segment" else None)
        return {name: ({key: pl.realised(t_, self.seed, "anomaly", name, key, *who) for key, t_ in t.items()} if isinstance(t, dict) and "kind" in t else pl.realised(t, self.seed, "anomaly", name, *who)) for name, t in x["templates"].items()}

    def _minimum(self, x: dict) -> int:
        p, first = self.conf["anomaly_policy"], x["series"]["base-oscillations"][0]
        least = pl.minimum_length(x["anomaly"], p["min_segment_length_by_anomaly"], osc.period_size(first["kind"], x["series"]["length"], first))
        return int(x["special"].get("min_segment_length", x["planner"].get("min_segment_length", least)))

    def _count_range(self, x: dict):
        own = self.conf["anomaly_policy"]["special_anomaly_policies"].get(x["anomaly"], {})
        return own.get("segment_count_range", x["planner"].get("segment_count_range", x["special"]["segment_count_range"]))

    def _planned_on_samples(self, drafts: list[dict]) -> dict:
        """Segments of the planners that look at the clean samples: each instance's channels go to one task, segments come back.

        A plan that fails is its message.
        """
        ship(self.spark)
        engine = Engine(self.spark, {"timeseries": [x["series"] for x in drafts]}, seed=self.seed)
        value = F.col("base") + F.col("noise") + F.col("trend") + F.col("offset")
        rows = engine.clean().select("series", "channel", "t", value.alias("value"))
        by = {x["instance"]: (x["planner"], x["density"], self._count_range(x), self._minimum(x), x["seed"], x["special"]["overlap_policy"], [self._parameters(x, j) for j in range(max(self._count_range(x)))] if x["anomaly"] == "trend" else []) for x in drafts}
        channels = self.conf["dataset"]["channels"]

        def run(key, table):
            import numpy as np
            import pyarrow as pa

            name = key[0].as_py()
            conf, density, counts, least, seed, overlap, own = by[name]
            at = np.lexsort((table.column("t").to_numpy(), table.column("channel").to_numpy()))
            values = table.column("value").to_numpy()[at].reshape(channels, -1)
            try:
                if conf["planner"] == "energy_aware_segments":
                    out = pl.energy_plan(values, density, conf, counts, least, (seed,), overlap)
                else:
                    out = pl.trend_plan(density, values.shape[1], channels, conf, counts, least, own.__getitem__, (seed,), overlap, values)
            except ValueError as e:
                out = str(e)
            return pa.table({"series": [name], "plan": [json.dumps(out)]})

        got = rows.groupBy("series").applyInArrow(run, "series string, plan string").collect()  # segments are bounded by the configuration
        return {r.series: json.loads(r.plan) for r in got}

    def _instance(self, x: dict, planned=None) -> dict:
        n, seed, special, planner = x["series"]["length"], x["seed"], x["special"], x["planner"]
        channels = x["series"]["base-oscillations"]
        overlap = special["overlap_policy"]
        if isinstance(planned, str):
            raise ValueError(planned)
        if planned is not None:
            segments = [tuple(p) for p in planned]
        elif planner["planner"] == "point_events_from_density":
            busy: dict = {}
            for j in sorted(range(n), key=lambda t: (draw(seed, "point", t), t))[: int(x["density"] * n)]:
                busy[j] = int(draw(seed, "channel", j) * len(channels))
            segments = [(c, t, t + 1, {}) for t, c in sorted(busy.items())]
        elif planner["planner"] == "period_locked_frequency":
            segments = pl.period_plan(x["density"], n, [c.get("frequency", 10.0) if osc.periods(c["kind"], n, c) else None for c in channels], planner, self._count_range(x), (seed,), overlap)
        else:
            low, high = sorted(map(int, self._count_range(x)))
            count = low + int(draw(seed, "count") * (high - low + 1))
            segments = [(*p, {}) for p in pl.uniform_plan(x["density"], count, n, len(channels), (seed,), self._minimum(x), overlap)]
        self._check_density(x, segments)
        anomalies = []
        for j, (c, s, e, found) in enumerate(segments):
            own = pl.adapt(x["anomaly"], self._parameters(x, j), found, planner, j, (seed,))
            if x["anomaly"] == "pattern-shift":
                own["transition_window"] = max(1, min(own["transition_window"], (e - s) // 2))
                own["shift_by"] = max(-own["transition_window"], min(own["shift_by"], own["transition_window"]))
            anomalies.append({"exact-position": s, "length": e - s, "channel": c, "kinds": [{"kind": x["anomaly"], **own}]})
        out = {k: x[k] for k in ("instance", "variant", "split", "base", "anomaly", "density", "planner")}
        return out | {"series": {**x["series"], "anomalies": anomalies}, "segments": [p[:3] for p in segments], "attributes": [p[3] for p in segments]}

    def _check_density(self, x: dict, segments) -> None:
        """ValueError if the covered share of the time is out of its range or too far from the target."""
        p = self.conf["anomaly_policy"]["special_anomaly_policies"].get(x["anomaly"], {})
        tolerance = float(p.get("density_tolerance", x["planner"].get("density_tolerance", x["special"]["density_tolerance"])))
        if tolerance < 0:
            raise cfg.ConfigError("density_tolerance: not negative")
        n, covered, end = x["series"]["length"], 0, 0
        for _, s, e, _ in sorted(segments, key=lambda y: (y[1], y[2])):
            covered += max(0, e - max(s, end))
            end = max(end, e)
        low, high = x["special"]["density_range"]
        if not low - tolerance <= covered / n <= high + tolerance or abs(covered / n - x["density"]) > tolerance:
            raise ValueError(f"the segments cover {covered / n:.6f} of the time, wanted are {x['density']:.6f} within {low} and {high}, give or take {tolerance}")

    # --- frames ---------------------------------------------------------------------------

    def engine(self) -> Engine:
        return Engine(self.spark, {"timeseries": [i["series"] for i in self.instances]}, seed=self.seed)

    def samples(self) -> DataFrame:
        """series, channel, t, clean, anomalous and label of every sample.

        Outside the segments of a channel both values are equal. Labels are by channel and follow
        the segments, or the samples an anomaly changes (``effective_support``).
        """
        from ..operators import anomalies as an
        from ..operators import series

        engine = self.engine()
        rows, wins = engine.clean(), engine.windows()
        weight = self.conf["variants"]["base_channel_correlation"].get("shared_noise_weight", 0.0)
        rows = series.shared_noise(rows, weight, self.seed)
        value = F.col("base") + F.col("noise") + F.col("trend") + F.col("offset")
        rows = rows.withColumn("clean", value)
        if wins:
            frame = self.spark.createDataFrame(wins, an.WINDOWS)
            kinds, bases = {w[5] for w in wins}, {i["base"] for i in self.instances}
            rows = an.inject(rows, frame, kinds, bases, {w[an.TREND][0] for w in wins if w[an.TREND]}, engine._alternatives(wins), engine._walks(wins), few=len(wins) <= an.FEW)
        keys = ["series", "channel"]
        out = rows.select(*keys, "t", "clean", value.alias("anomalous"))
        return lb.point_labels(out, self.events(out), keys, few=len(wins) <= an.FEW)

    def events(self, samples: DataFrame | None = None) -> DataFrame:
        """series, channel, event, anomaly_type, start, end, source_start, source_end of every event."""
        rows = [(i["instance"], c, k, i["anomaly"], s, e) for i in self.instances for k, (c, s, e) in enumerate(i["segments"])]
        frame = self.spark.createDataFrame(rows, "series string, channel int, event int, anomaly_type string, start long, end long")
        p = self.conf["anomaly_policy"]
        if samples is None or p["support_label_mode"] == "strict_segment":
            return frame.withColumn("source_start", F.col("start")).withColumn("source_end", F.col("end"))
        before = samples.select("series", "channel", "t", F.col("clean").alias("before"), F.col("anomalous").alias("after"))
        moved = lb.effective_support(before, frame, ["series", "channel"], p["support_eps_value"], p["support_eps_mode"] == "relative", p["min_effective_label_length_non_extremum"])
        return moved.join(frame.select("series", "channel", "event", "anomaly_type"), ["series", "channel", "event"])

    def summary(self, samples: DataFrame | None = None) -> DataFrame:
        """One row for each instance: densities and segment lengths."""
        rows = [(i["instance"], i["variant"], i["split"], i["base"], i["anomaly"], i["density"]) for i in self.instances]
        frame = self.spark.createDataFrame(rows, "series string, variant string, split string, base string, anomaly string, target_density double")
        samples = self.samples() if samples is None else samples
        achieved = lb.density(samples.select("series", "channel", "t", "label"), ["series"]).withColumnRenamed("density", "achieved_density")
        lengths = st.instance_summary(self.events().select("series", "start", "end"), ["series"])
        return frame.join(achieved, "series").join(lengths, "series")

    def statistics(self) -> DataFrame:
        """Statistics by variant and split, by variant and overall."""
        return st.rollup_statistics(self.summary())

    def files(self, samples: DataFrame, column: str, prefix: str = "value", digits: int | None = 8) -> DataFrame:
        """variant, split, instance, t and one column for each channel, ``digits`` behind the point."""
        parts = F.split("series", "/")
        names = [F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(("variant", "split", "instance"))]
        value = lambda c: F.max(F.when(F.col("channel") == c, F.col(column)))
        shown = lambda c: F.format_string(f"%.{digits}f", value(c).cast("double")) if digits is not None else value(c).cast("byte")
        return samples.groupBy(*names, "t").agg(*[shown(c).alias(f"{prefix}-{c}") for c in range(self.conf["dataset"]["channels"])])

    def variant_configs(self) -> DataFrame:
        """variant and its configuration as JSON: templates, parameters that are fixed for it, planner and policies."""
        d, p, v = self.conf["dataset"], self.conf["anomaly_policy"], self.conf["variants"]
        rows = []
        for variant, base, anomaly in self.variants:
            b, a = self.cascade(variant, base, anomaly)
            own = [i for i in self.instances if i["variant"] == variant]
            fixed_base = v["base_parameter_policy"] == "fixed_per_variant" and own
            fixed_anomaly = v["anomaly_parameter_policy"] == "fixed_per_variant" and own and own[0]["series"]["anomalies"]
            rows.append((variant, json.dumps({
                "variant_id": variant, "profile_id": variant.rsplit("__", 1)[1],
                "base_oscillation": {"kind": base, "parameter_template": b, "channel_parameter_template": v["base_channel_overrides"].get(base, {}), "realized_parameters": own[0]["series"]["base-oscillations"] if fixed_base else None, "channel_correlation": v["base_channel_correlation"], "split_phase_shift": v["split_phase_shift"]},
                "anomaly_type": {"kind": anomaly, "parameter_template": a, "realized_parameters": own[0]["series"]["anomalies"][0]["kinds"][0] if fixed_anomaly else None},
                "dataset": {k: d[k] for k in ("length", "channels", "splits", "instances_per_split")},
                "anomaly_policy": {**{k: p[k] for k in ("density_range", "density_tolerance", "segment_count_range", "overlap_policy")}, "segment_planner": own[0]["planner"] if own else None},
                "parameter_policies": {k: v[k] for k in ("base_parameter_policy", "anomaly_parameter_policy")},
            }, sort_keys=True, indent=2, default=str)))
        return self.spark.createDataFrame(rows, "variant string, value string")

    def write(self, output: str, overwrite: bool = True) -> None:
        """Samples, clean.csv, anomalous.csv and labels_pointwise.csv by variant, split and instance; events, summaries, variant_config and a manifest.

        Without ``overwrite`` anything that is there already is an error. The samples are generated once.
        """
        mode = "overwrite" if overwrite else "errorifexists"
        parts = F.split("series", "/")
        samples = cut(self.samples())
        samples.withColumn("variant", F.get(parts, F.lit(0))).withColumn("split", F.get(parts, F.lit(1))).write.mode(mode).partitionBy("variant", "split").parquet(f"{output}/samples")
        keys = ["variant", "split", "instance"]
        for name, frame in (("clean", self.files(samples, "clean")), ("anomalous", self.files(samples, "anomalous")), ("labels_pointwise", self.files(samples, "label", "label", None))):
            # one file for each instance, whose length is bounded by the configuration
            frame.repartition(*keys).sortWithinPartitions(*keys, "t").drop("t").write.mode(mode).partitionBy(*keys).csv(f"{output}/{name}.csv", header=True)
        self.variant_configs().repartition("variant").write.mode(mode).partitionBy("variant").text(f"{output}/variant_config")
        events = cut(self.events(samples))
        events.write.mode(mode).json(f"{output}/events")
        summary = cut(self.summary(samples))
        summary.write.mode(mode).json(f"{output}/instances")
        st.rollup_statistics(summary).write.mode(mode).json(f"{output}/statistics")
        manifest = json.dumps({"config": self.conf, "variants": [x[0] for x in self.variants], "skipped": self.skipped}, sort_keys=True, default=str)
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode(mode).text(f"{output}/manifest")


def generate_dataset(spark: SparkSession, config, output: str, overwrite: bool = True) -> Dataset:
    """Plans a dataset and writes all its files."""
    out = Dataset(spark, config)
    out.write(output, overwrite)
    return out
