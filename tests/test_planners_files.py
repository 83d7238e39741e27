import csv
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidemark
from tidemark.functions import rng
from tidemark.operators import anomalies, planner, stats
from tidemark.plans.addons import COLUMNS, Metadata
from tidemark.plans.dataset import Dataset
from tidemark.plans.engine import Engine
from tidemark.sources import config as cfg

SINE = {"kind": "sine", "frequency": 4.0}


def one(channels, anomalies=(), n=600, **more):
    return {"timeseries": [{"name": "s", "length": n, "base-oscillations": channels, "anomalies": list(anomalies), **more}]}


def data(anomaly, policy=None, base="sine", n=600, **variants):
    return {
        "dataset": {"length": n, "channels": 2, "splits": ["train"], "instances_per_split": 2},
        "variants": {"base_oscillations": [base], "anomaly_types": [anomaly], "base_oscillation_overrides": {base: {"frequency": 5.0, "amplitude": 1.0, "variance": 0.0}}, **variants},
        "anomaly_policy": {"density_range": [0.10, 0.14], "density_tolerance": 0.02, "segment_count_range": [2, 4], **(policy or {})},
    }


def test_planner_resolution():
    settings = {"default": {"planner": "energy_aware_segments", "rms_quantile": 0.5}, "mean": {"rms_quantile": 0.7}}
    assert planner.resolve({}, "extremum")["planner"] == "point_events_from_density" and planner.resolve({}, "mean")["planner"] == "uniform_segments"
    assert planner.resolve(settings, "mean") == {"planner": "energy_aware_segments", "rms_quantile": 0.7}
    assert planner.resolve(settings, "mean", {"segment_planner": {"rms_quantile": 0.8}}, {"planner": "Uniform_Segments"}) == {"planner": "uniform_segments", "rms_quantile": 0.8}
    for settings, kind in (({"mean": {"planner": "none"}}, "mean"), ({"mean": {"planner": "period_locked_frequency"}}, "mean"), ({"default": {"planner": "trend_parameter_aware_segments"}}, "platform")):
        with pytest.raises(cfg.ConfigError):
            planner.resolve(settings, kind)


def test_period_locked_segments(spark):
    conf = {"segment_planner": {"frequency": {"planner": "period_locked_frequency", "periods_per_segment_range": [1, 2], "frequency_factor_bounds": [0.4, 2.5]}}}
    d = Dataset(spark, data("frequency", conf))
    bounds = set(planner.boundaries(600, 5.0))
    assert len(d.instances) == 2
    for i in d.instances:
        for (c, s, e), found, a in zip(i["segments"], i["attributes"], i["series"]["anomalies"]):
            k, factor = found["period_count"], a["kinds"][0]["frequency_factor"]
            assert {s, e} <= bounds and factor in ((k - 1) / k, (k + 1) / k)
    assert planner.boundaries(600, 200.0) is None and planner.boundaries(1, 5.0) is None
    free = planner.period_plan(0.3, 600, [5.0, None], {"align_to_period_start": False, "periods_per_segment_range": [3, 2]}, (1, 50), (7,), "per_channel")
    assert all(c == 0 and (e - s) % 20 == 0 for c, s, e, _ in free)
    with pytest.raises(ValueError):
        planner.period_plan(0.1, 600, [None], {}, (1, 2), (7,))


def test_energy_aware_segments(spark):
    t = np.arange(1000)
    values = np.stack([np.where(t < 500, 0.1, 5.0) * np.sin(t / 3), np.full(1000, 0.01)])
    plan = planner.energy_plan(values, 0.1, {"energy_metric": "rms_and_peak"}, (3, 3), 5, (1,))
    assert sum(e - s for _, s, e, _ in plan) == 100 and all(a[2] <= b[1] for a, b in zip(plan, plan[1:]))
    assert all(c == 1 or s > 400 for c, s, _, _ in plan) and not any(f["energy_fallback"] for *_, f in plan)
    for c, s, e, f in plan:
        assert f["window_rms"] == pytest.approx(math.sqrt(np.mean(values[c, s:e] ** 2))) and f["window_peak"] == pytest.approx(np.abs(values[c, s:e]).max())
    with pytest.raises(ValueError):
        planner.energy_plan(values, 0.1, {"energy_metric": "sum"}, (3, 3), 5, (1,))
    d = Dataset(spark, data("amplitude", {"segment_planner": {"amplitude": {"planner": "energy_aware_segments", "adaptive_strength": True, "min_effect_delta": 2.0, "amplitude_factor_bounds": [0.2, 9.0]}}}))
    for i in d.instances:
        for f, a in zip(i["attributes"], i["series"]["anomalies"]):
            assert abs(a["kinds"][0]["amplitude_factor"] - 1) * f["window_rms"] >= min(2.0, 0.8 * f["window_rms"]) - 1e-9


def test_energy_segments_read_a_bounded_number_of_candidates(spark, monkeypatch):
    length, count, seed, sizes = 6, 5, 3, {"flat": 400, "burst": 3000, "short": 16}
    r = np.random.default_rng(1)
    values = {i: r.normal(size=(3, n)) for i, n in sizes.items()}
    values["burst"][1, 500:540] *= 50  # the best starts overlap: many of them are met before five are taken
    rows = [(i, c, t, float(x)) for i, v in values.items() for (c, t), x in np.ndenumerate(v)]
    samples = spark.createDataFrame(rows, "instance string, channel int, t long, value double").repartition(7)
    seen, grouped = [], planner._grouped
    monkeypatch.setattr(planner, "_grouped", lambda df, f: seen.append(df) or grouped(df, f))
    got = [tuple(x) for x in planner.energy_segments(samples, length, count, 0.6, seed).orderBy("instance", "segment").collect()]
    want = []
    for i, v in sorted(values.items()):
        rms = np.sqrt(np.lib.stride_tricks.sliding_window_view(v * v, length, axis=1).mean(axis=2))
        cut = np.quantile(rms, 0.6)
        race = sorted((-math.log(rng.draw(seed, "race", i, c, t)) / (1 + x - cut), c, t) for (c, t), x in np.ndenumerate(rms) if x >= cut)
        taken = []
        for _, c, t in race:
            if len(taken) < count and all(abs(t - u) >= length for u, _ in taken):
                taken.append((t, c))
        want += [(i, k, c, t, t + length) for k, (t, c) in enumerate(sorted(taken))]
    assert got == want and sum(x[0] == "short" for x in got) < count
    # a plan's rows do not grow with the samples: 400 and 3,000 in each channel give as many
    read = {x["instance"]: x["count"] for x in seen[0].groupBy("instance").count().collect()}
    assert read["flat"] == read["burst"] == (count - 1) * (2 * length - 1) + 1 >= read["short"]


def test_large_quantiles_are_the_exact_ones(spark):
    r = np.random.default_rng(2)
    inf = float("inf")
    odd = [inf, -inf, float("nan"), 0.0, -0.0, 5e-324, -1e300, 1.7e308]
    groups = {"normal": r.normal(size=700), "narrow": 1 + r.random(300) * 1e-9, "equal": np.full(50, 7.0), "wide": -r.random(300) * 10.0 ** r.integers(-300, 300, 300), "odd": r.choice(odd, 90), "one": [3.5]}
    rows = [(k, float(x)) for k, v in groups.items() for x in v]
    df = spark.createDataFrame([*rows, ("normal", None), ("one", None)], "k string, x double").repartition(5)
    # text, because no number equals NaN
    read = lambda f, q: {x.k: repr(x.threshold) for x in f(df, "x", q, ["k"]).collect()}
    for q in (0.0, 0.6, 0.977, 1.0):
        assert read(stats.large_quantiles, q) == read(stats.quantiles, q)
    plan = stats.large_quantiles(df, "x", 0.6, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_trend_aware_segments(spark):
    own = [{"oscillation": {"kind": "sine", "frequency": f}} for f in (0.5, 2.0, 30.0)] + [{"oscillation": {"kind": "random-walk"}}]
    plan = planner.trend_plan(0.1, 1000, 2, {}, (4, 4), 5, own.__getitem__, (3,))
    assert sum(e - s for _, s, e, _ in plan) == 100 and all(e - s >= f["trend_min_segment_length"] for _, s, e, f in plan)
    assert sorted(f["trend_min_segment_length"] for *_, f in plan) == [5, 8, 15, 60]
    assert [f["trend_min_segment_length"] for *_, f in planner.trend_plan(0.03, 1000, 2, {}, (1, 1), 5, own.__getitem__, (3,))] == [30]
    d = Dataset(spark, data("trend", {"segment_planner": {"trend": {"planner": "trend_parameter_aware_segments", "adaptive_strength": True, "min_effect_delta": 0.7}}}))
    for i in d.instances:
        assert all("window_rms" in f and a["kinds"][0]["min_effect_delta"] == 0.7 for f, a in zip(i["attributes"], i["series"]["anomalies"]))


def test_parameters_are_sanitised_and_adapted():
    assert planner.sanitise("pattern-shift", {"shift_by": 0, "transition_window": -4, "crossfade_mode": "LINEAR"}) == {"shift_by": 1, "transition_window": 4, "crossfade_mode": "linear"}
    assert planner.sanitise("extremum", {"context_window": -3, "min": 1}) == {"context_window": 3, "min": True}
    assert planner.sanitise("trend", {"transition_length": -2, "min_effect_delta": -1, "envelope_kind": "Sine2"}) == {"transition_length": 0, "min_effect_delta": 0.0, "envelope_kind": "sine2"}
    assert planner.adapt_factor(1.0, 0.5, {"adaptive_strength": True, "min_effect_delta": 0.2}, 0) == pytest.approx(0.6)
    assert planner.adapt_factor(1.05, 0.0, {"amplitude_factor_deadzone": [0.9, 1.1]}, 0) == 1.1
    with pytest.raises(ValueError):
        planner.choose_ratio(1, {"period_ratio_offsets": [-1]}, (1,))
    assert planner.minimum_length("trend", {}, 20) == 40 and planner.minimum_length("mean", {"mean": 9}) == 9 and planner.minimum_length("frequency", {}) == 1


def test_density_is_checked(spark):
    loose = data("frequency", {"density_tolerance": 0.0, "segment_planner": {"frequency": {"planner": "period_locked_frequency"}}})
    assert Dataset(spark, loose).instances == [] and "cover" in Dataset(spark, loose).skipped[0][1]
    with pytest.raises(ValueError):
        Dataset(spark, {**loose, "generator": {"on_variant_failure": "fail_fast"}})


def test_files_of_a_dataset(spark, tmp_path):
    d = tidemark.generate_dataset(spark, data("mean", n=120), str(tmp_path / "d"))
    base = tmp_path / "d"
    name = next(i["instance"] for i in d.instances).split("/")
    where = "/".join(f"{k}={v}" for k, v in zip(("variant", "split", "instance"), name))
    read = lambda kind: [r for f in (base / f"{kind}.csv" / where).glob("part-*.csv") for r in csv.DictReader(f.open())]
    clean, broken, labels = read("clean"), read("anomalous"), read("labels_pointwise")
    assert len(clean) == len(broken) == len(labels) == 120 and list(clean[0]) == ["value-0", "value-1"] and list(labels[0]) == ["label-0", "label-1"]
    assert len(clean[5]["value-0"].split(".")[1]) == 8 and clean[3]["value-0"] == f"{math.sin(2 * math.pi * 5 * 1.2 * 3 / 119):.8f}"
    assert all(clean[t][f"value-{c}"] == broken[t][f"value-{c}"] for t in range(120) for c in (0, 1) if labels[t][f"label-{c}"] == "0")
    conf = json.loads("\n".join(r.value for f in [base / "variant_config"] for r in spark.read.text(str(f), wholetext=True).collect()))
    assert conf["variant_id"] == "sine__mean__p00" and conf["anomaly_policy"]["segment_planner"] == {"planner": "uniform_segments"}
    with pytest.raises(Exception, match="(?i)exist"):
        d.write(str(base), overwrite=False)


def test_custom_inputs_are_keyed_and_checked(spark):
    rows = spark.createDataFrame([(k, t, float(10 * k + t)) for k in (1, 2) for t in range(8 + k)], "key long, t long, value double")
    use = lambda k: {"kind": "custom-input", "input": "x", "key": k}
    got = Engine(spark, one([use(2), use(1)], n=9), inputs={"x": rows}).samples()
    assert {(r.channel, r.t): r.value for r in got.collect()} == {(c, t): float(10 * k + t) for c, k in ((0, 2), (1, 1)) for t in range(9)}
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    for bad in (one([use(2), use(1)], n=10), one([use(3)], n=5)):
        with pytest.raises(ValueError, match="samples"):
            Engine(spark, bad, inputs={"x": rows}).samples()
    with pytest.raises(cfg.ConfigError):
        Engine(spark, one([{"kind": "custom-input", "input": "y"}], n=5)).samples()


def test_closed_form_plans_move_no_sample(spark):
    plan = Engine(spark, one([SINE], [{"exact-position": 10, "length": 20, "kinds": [{"kind": "mean", "offset": 1.0}]}])).samples()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_many_windows_meet_their_samples_by_span(spark, monkeypatch):
    conf = one([SINE, {"kind": "cosine", "variance": 0.1}], [{"exact-position": s, "length": 30, "channel": s % 2, "kinds": [{"kind": k, **p}]} for s, (k, p) in zip(range(20, 560, 60), [("mean", {"offset": 1.0}), ("extremum", {"local": True}), ("trend", {"oscillation": {"kind": "sine"}, "boundary_mode": "legacy_carry_over"}), ("pattern-shift", {"shift_by": 2, "transition_window": 4}), ("amplitude", {"amplitude_factor": 2.0}), ("variance", {"variance": 1.0})])])
    want = sorted(map(tuple, Engine(spark, conf).samples().select("channel", "t", F.round("value", 9), "is_anomaly").collect()))
    monkeypatch.setattr(anomalies, "FEW", 0)
    monkeypatch.setattr(anomalies, "SPAN", 16)
    assert sorted(map(tuple, Engine(spark, conf).samples().select("channel", "t", F.round("value", 9), "is_anomaly").collect())) == want


def test_kinds_of_ones_own(spark):
    tidemark.register_oscillation("stairs-test", lambda rows: rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("t")).withColumn("base", F.floor(F.col("t") / 10).cast("double")))
    tidemark.register_anomaly("tilt-test", lambda x, i, n, p: x + p["slope"] * i, {"slope": 1.0}, ("stairs-test", "sine"))
    df = Engine(spark, one([{"kind": "stairs-test"}], [{"exact-position": 20, "length": 10, "kinds": [{"kind": "tilt-test", "slope": 0.5}]}], n=50)).samples()
    assert [r.value for r in df.orderBy("t").collect()] == [t // 10 + (0.5 * (t - 20) if 20 <= t < 30 else 0) for t in range(50)]
    with pytest.raises(ValueError):
        tidemark.register_oscillation("sine", lambda rows: rows)
    with pytest.raises(ValueError):
        tidemark.register_anomaly("mean", lambda *a: a[0])


def test_public_names_and_functions(spark):
    assert tidemark.Engine is Engine and set(tidemark.__all__) >= {"Engine", "Dataset", "api"}
    with pytest.raises(AttributeError):
        tidemark.nothing  # noqa: B018
    api = tidemark.api
    for f in (api.random_walk, api.cylinder_bell_funnel, api.mls):
        rows = f(spark, length=80, seed=3).orderBy("t").collect()
        assert [r.t for r in rows] == list(range(80)) and len({r.value for r in rows}) > 3
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "a double, b double")
    total = api.formula({"base": 0, "operation": {"kind": "*", "operand": {"base": 1, "aggregation": {"kind": "sum"}}}}, F.col("a"), F.col("b"))
    assert sorted(r[0] for r in df.select(total).collect()) == [7.0, 21.0]


def test_metadata_columns(spark, tmp_path):
    conf = one([{"kind": "ecg", "frequency": 10, "trend": SINE}], [{"exact-position": 500, "length": 40, "kinds": [{"kind": "mean", "offset": 1.0}]}], n=1000, **{"supervised": True})
    engine = Engine(spark, conf, add_ons=["metadata", Metadata])
    engine.generate()
    rows = {r.dataset_name: r for r in engine.add_ons[0].data["table"].collect()}
    r = rows["s.supervised"]
    assert len(COLUMNS) == 22 and tuple(r.asDict()) == COLUMNS and set(rows) == {"s.unsupervised", "s.supervised"}
    assert (r.train_path, r.test_path, r.train_is_normal, r.input_type, r.contamination, r.period_size, r.trend) == ("s/train_anomaly", "s/test", False, "univariate", 0.04, 10, "sine")
    assert rows["s.unsupervised"].train_path is None and rows["s.unsupervised"].median_anomaly_length == 40


def test_fast_draws(spark):
    conf = one([{"kind": "sine", "variance": 0.3}, {"kind": "random-walk"}], [{"position": "end", "length": 40, "kinds": [{"kind": "variance", "variance": 0.8}]}], n=2000)
    rows = lambda **o: sorted((r.channel, r.t, r.value, r.is_anomaly) for r in Engine(spark, conf, **o).samples().collect())
    fast, plain = rows(fast=True), rows()
    assert fast == rows(fast=True) != plain and [x[3] for x in fast] == [x[3] for x in plain]
    z = [r.noise / 0.3 for r in Engine(spark, conf, fast=True).clean().where("channel = 0").collect()]
    assert abs(np.mean(z)) < 0.1 and abs(np.std(z) - 1) < 0.1
