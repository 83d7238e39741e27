import csv
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import formula, rng
from tidemark.functions import oscillators as osc
from tidemark.operators import labels, planner, series
from tidemark.plans import exact, placement
from tidemark.plans.addons import AddOn, Metadata, resolve
from tidemark.plans.dataset import Dataset
from tidemark.plans.engine import Engine
from tidemark.sources import config as cfg
from tidemark.sources import tables

SINE = {"kind": "sine", "frequency": 4.0}


def one(channels, anomalies=(), n=600, **more):
    return {"timeseries": [{"name": "s", "length": n, "base-oscillations": channels, "anomalies": list(anomalies), **more}]}


def values(df, channel=0):
    return [r.value for r in df.where(F.col("channel") == channel).orderBy("t").collect()]


def test_draws_agree_with_the_driver(spark):
    got = spark.range(5).select(rng.uniform("a", F.col("id")).alias("u"), rng.seed_column("a", F.col("id")).alias("s")).collect()
    assert [r.u for r in got] == [rng.draw("a", k) for k in range(5)] and [r.s for r in got] == [rng.seed_of("a", k) for k in range(5)]


def test_normal_draws(spark):
    r = spark.range(20000).select(rng.normal("x", F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.03


def test_results_do_not_depend_on_partitions_or_other_series(spark):
    conf = one([{"kind": "random-walk", "variance": 0.1}], [{"position": "end", "length": 20, "kinds": [{"kind": "variance", "variance": 1.0}]}])
    a = values(Engine(spark, conf).samples())
    both = {"timeseries": [{"name": "other", "length": 50, "base-oscillations": [SINE], "anomalies": []}, *conf["timeseries"]]}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = values(Engine(spark, both).samples().where("series = 's'"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b and a != values(Engine(spark, conf, seed=1).samples())


def test_splits(spark):
    conf = one([SINE], [{"position": "middle", "length": 30, "kinds": [{"kind": "mean", "offset": 1.0}]}], **{"semi-supervised": True, "supervised": True})
    got = {r.split: r.n for r in Engine(spark, conf).samples().groupBy("split").agg(F.sum("is_anomaly").alias("n")).collect()}
    assert got == {"test": 30, "train_no_anomaly": 0, "train_anomaly": 30}


def test_last_anomaly_wins_and_kinds_add_up(spark):
    mean = lambda v, s: {"exact-position": s, "length": 20, "kinds": [{"kind": "mean", "offset": v}]}
    x = values(Engine(spark, one([{"kind": "polynomial", "polynomial": [0]}], [mean(1.0, 10), mean(5.0, 20), {"exact-position": 50, "length": 5, "kinds": [{"kind": "platform", "value": 0.5}, {"kind": "mean", "offset": 1.0}]}])).samples())
    assert x[9:11] == [0, 1] and x[19:21] == [1, 5] and x[39:41] == [5, 0] and x[50:55] == [1.5] * 5


def test_noop_amplitude_of_short_windows_is_labelled(spark):
    conf = one([SINE], [{"exact-position": 100, "length": 7, "kinds": [{"kind": "amplitude", "amplitude_factor": 3.0}]}])
    df = Engine(spark, conf).samples()
    assert values(df) == pytest.approx(values(Engine(spark, one([SINE])).samples())) and df.agg(F.sum("is_anomaly")).first()[0] == 7


@pytest.mark.parametrize("length", [25, 30, 49])
@pytest.mark.parametrize("creep", [0, 10])
def test_amplitude_lengths(spark, length, creep):
    conf = one([{"kind": "polynomial", "polynomial": [1]}, {"kind": "sine"}], [{"exact-position": 50, "length": length, "channel": 1, "creeping-length": creep, "kinds": [{"kind": "amplitude", "amplitude_factor": 2.0}]}])
    x, y = values(Engine(spark, conf).samples(), 1), values(Engine(spark, one([SINE, {"kind": "sine"}])).samples(), 1)
    ratio = [a / b for a, b in zip(x, y) if abs(b) > 1e-6]
    assert max(ratio) == pytest.approx(2.0) and min(ratio) >= 1 - 1e-9


def test_reversed_windows(spark):
    conf = one([{"kind": "mls", "complexity": 5}], [{"exact-position": 100, "length": 9, "kinds": [{"kind": "pattern"}]}])
    x, y = values(Engine(spark, conf).samples()), values(Engine(spark, one([{"kind": "mls", "complexity": 5}])).samples())
    assert x[100:109] == pytest.approx(y[100:109][::-1]) and x[:100] == y[:100]


def test_shift_reaches_its_floor(spark):
    conf = one([SINE], [{"exact-position": 100, "length": 40, "kinds": [{"kind": "pattern-shift", "shift_by": 1, "transition_window": 3, "min_effect_delta": 4.0}]}])
    x, y = values(Engine(spark, conf).samples()), values(Engine(spark, one([SINE])).samples())
    assert max(abs(a - b) for a, b in zip(x, y)) == pytest.approx(4.0) and x[100] == y[100] and x[139] == y[139]


def test_shared_modes(spark):
    rmj = {"kind": "random-mode-jump", "frequency": 20, "channel-offset": 1, "random-seed": 9}
    df = Engine(spark, one([rmj, rmj], [{"exact-position": 60, "length": 30, "channel": 1, "kinds": [{"kind": "mode-correlation"}]}])).samples()
    a, b = values(df), values(df, 1)
    assert all((x == -y) == (60 <= t < 90) for t, (x, y) in enumerate(zip(a, b)))


def test_lfsr_has_full_period():
    out = series.lfsr(5, [2], [1, 0, 0, 0, 0])
    assert len(out) == 31 and sum(out) == 16


def test_config_errors():
    for bad in ({}, {"timeseries": []}, one([{"kind": "nope"}]), one([SINE], [{"length": 5, "kinds": [{"kind": "nope"}]}]), one([SINE], [{"kinds": []}]), one([SINE], [{"length": 5, "channel": 3, "kinds": []}]), one([SINE], [{"length": 5, "kinds": [{"kind": "mode-correlation"}]}])):
        with pytest.raises(cfg.ConfigError):
            cfg.normalise(bad)
    assert cfg.normalise(one([SINE], [{"length": 5, "kinds": [{"kind": "mode-correlation"}]}]), skip_errors=True)[0]["anomalies"] == []
    assert sum(map(len, cfg.ALLOWED.values())) == 91
    with pytest.raises(ValueError):
        formula.check({"base": 0, "operation": {"kind": "+", "operand": 1}, "aggregation": {"kind": "sum"}})


def test_placement():
    ts = cfg.normalise(one([SINE], [{"position": p, "length": 20, "kinds": [{"kind": "mean", "offset": 1}]} for p in ("beginning", "middle", "end")] * 3))[0]
    spans = placement.place(ts, "test", 42)
    assert all(not placement.collides(a, [b]) for k, a in enumerate(spans) for b in spans[:k])
    assert [s // 200 for s, _ in spans[:3]] == [0, 1, 2]
    with pytest.raises(ValueError):
        placement.place(cfg.normalise(one([SINE], [{"position": "end", "length": 150, "kinds": []}] * 3))[0], "test", 42)
    assert placement.collides((0, 100), [(40, 50)]) and not placement.collides((0, 100), [(40, 50)], compat=True)
    assert osc.period_size("dirichlet", 1000, {"frequency": 10, "periodicity": 6}) == 20


def test_formula_division(spark):
    r = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (6.0, 3.0)], "a double, b double").select(formula.divide(F.col("a"), F.col("b")).alias("q")).collect()
    assert r[0].q == math.inf and math.isnan(r[1].q) and r[2].q == -math.inf and r[3].q == 2


def test_custom_csv(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("a,b,c\n" + "".join(f"{k},{k / 2},x{k}\n" for k in range(700)))
    assert [r.value for r in tables.indexed_csv(spark, str(p), "b", 600).orderBy("t").collect()] == [k / 2 for k in range(600)]
    for column, n in (("c", 5), ("a", 701), ("zz", 5), (9, 5)):
        with pytest.raises(ValueError):
            tables.indexed_csv(spark, str(p), column, n)
    x = values(Engine(spark, one([{"kind": "custom-input", "input-timeseries-path-test": str(p), "use-column-test": 0}])).samples())
    assert x == [float(k) for k in range(600)]
    with pytest.raises(cfg.ConfigError):
        Engine(spark, one([{"kind": "custom-input"}])).samples()


def test_metadata_and_files(spark, tmp_path):
    conf = one([{"kind": "random-mode-jump", "frequency": 50, "channel-offset": 1}] * 2, [{"exact-position": 500, "length": 20, "kinds": [{"kind": "mode-correlation"}]}], n=1000)
    meta = Metadata(str(tmp_path / "datasets"))
    Engine(spark, conf, add_ons=[meta]).generate(str(tmp_path / "out"))
    r = meta.data["table"].first()
    assert (r.length, r.dimensions, r.contamination, r.num_anomalies, r.period_size) == (1000, 2, 0.02, 1, 20)
    rows = [x for f in (tmp_path / "out/s/test").glob("part-*.csv") for x in csv.DictReader(f.open())]
    assert len(rows) == 1000 and list(rows[0]) == ["timestamp", "value-0", "value-1", "is_anomaly"]
    assert list((tmp_path / "out/overview").glob("part-*")) and list((tmp_path / "datasets").glob("part-*"))
    assert isinstance(resolve("tidemark.plans.addons.Metadata"), AddOn)
    for bad in ("nothing", "json.JSONDecoder"):
        with pytest.raises(ValueError):
            resolve(bad)


DATA = {"dataset": {"length": 300, "channels": 2, "splits": ["train", "val"], "instances_per_split": 2}, "variants": {"base_oscillations": ["sine"], "anomaly_types": ["mean", "platform", "mode-correlation"]}, "anomaly_policy": {"density_range": [0.05, 0.1], "segment_count_range": [2, 3]}}


def test_dataset_invariants(spark, tmp_path):
    d = Dataset(spark, DATA)
    assert [v[0] for v in d.variants] == ["sine__mean__p00", "sine__platform__p00"] and d.skipped == [("sine__mode-correlation__p00", "incompatible")]
    rows = d.samples().cache()
    assert rows.count() == 2 * 4 * 2 * 300
    assert rows.where("label = 0 and clean <> anomalous").count() == 0 and rows.where("label = 1 and clean <> anomalous").count() > 0
    assert labels.mismatches(rows.select("series", "channel", "t", "label"), d.events(), ["series", "channel"]).count() == 0
    s = d.summary().collect()
    assert all(abs(r.achieved_density - r.target_density) <= 0.003 and 2 <= r.segments <= 3 for r in s)
    again = Dataset(spark, json.loads(json.dumps(DATA))).samples()
    assert again.exceptAll(rows).count() == 0
    d.write(str(tmp_path / "data"))
    assert spark.read.parquet(str(tmp_path / "data/samples")).count() == rows.count()
    with pytest.raises(cfg.ConfigError):
        Dataset(spark, {**DATA, "anomaly_policy": {"density_range": [0, 2]}})


def test_effective_labels(spark):
    conf = {**DATA, "anomaly_policy": {**DATA["anomaly_policy"], "support_label_mode": "effective_support", "min_effective_label_length_non_extremum": 4}}
    d = Dataset(spark, conf)
    for r in d.events(d.samples()).collect():
        assert r.source_start <= r.start < r.end <= r.source_end and r.end - r.start >= min(4, r.source_end - r.source_start)


def test_planners(spark):
    for r in planner.uniform_segments(spark, [("a", 0.1, 5), ("b", 0.3, 4)], 500, 2, 1).groupBy("instance").agg(F.collect_list(F.struct("start", "end")).alias("x")).collect():
        spans = sorted(map(tuple, r.x))
        assert sum(e - s for s, e in spans) == (50 if r.instance == "a" else 150) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert planner.trend_minima([1.0, 2.0, 50.0], 1000, 0.3, 20) == [15, 5]
    assert planner.trend_minima([0.5], 1000, 0.3, 20) == [20]
    with pytest.raises(ValueError):
        planner.place_lengths([60, 60], 100, 1, ("x",))
    bounds = {r.t for r in planner.period_boundaries(spark, [("x", 1000, 7.0)]).collect()}
    for r in planner.period_segments(spark, [("x", 1000, 7.0)], 2, 1).collect():
        assert {r.start, r.end} <= bounds
    r = planner.realise(spark.range(300), {"a": {"min": -1.0, "max": 1.0, "reject_if_abs_lt": 0.5}, "b": [2.0, 3.0]}, ["s"], ["id"]).agg(F.min(F.abs("a")), F.min("b"), F.max("b")).first()
    assert r[0] >= 0.5 and 2 <= r[1] < r[2] < 3


def test_exact_mode_is_deterministic_and_seeded(spark):
    conf = one([{"kind": "sine", "frequency": 5, "variance": 0.1}], [{"position": "middle", "length": 30, "creeping-length": 10, "kinds": [{"kind": "mean", "offset": 1.0}]}])
    a = values(exact.samples(spark, conf))
    assert a == values(exact.samples(spark, conf)) != values(exact.samples(spark, conf, seed=1))
    assert exact.samples(spark, conf).agg(F.sum("is_anomaly")).first()[0] == 30


def test_exact_mode_gives_known_samples():
    sine = {"kind": "sine"}
    got, lab = exact.series_values(cfg.normalise({"timeseries": [{"name": "extremum", "length": 1000, "base-oscillations": [sine], "anomalies": [{"position": "beginning", "length": 1, "kinds": [{"kind": "extremum", "min": True}]}]}]})[0], 42)
    # fixed values: the sample and place of the one extremum
    assert lab.tolist().index(1) == 30 and lab.sum() == 1 and abs(got[30, 0] + 2.277481352367378) < 1e-12
    got, lab = exact.series_values(cfg.normalise({"timeseries": [{"name": "mean", "length": 1000, "base-oscillations": [sine], "anomalies": [{"position": "middle", "length": 340, "creeping-length": 300, "kinds": [{"kind": "mean", "offset": 1.0}]}]}]})[0], 42)
    assert lab.tolist().index(1) == 371 and lab.sum() == 340 and abs(got[371, 0] - 0.7589232914680893) < 1e-12


def test_stream(spark, tmp_path):
    from tidemark.streaming import live, windowed

    spark.range(100).select(F.timestamp_seconds(F.col("id")).alias("timestamp"), F.col("id").alias("value")).write.parquet(str(tmp_path / "ticks"))
    source = spark.readStream.schema("timestamp timestamp, value long").parquet(str(tmp_path / "ticks"))
    q = windowed(live(spark, one([SINE], n=100), source=source)).writeStream.outputMode("complete").format("memory").queryName("live_test").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from live_test").first()[0] == 100


def test_api(spark):
    from tidemark.functions import api

    x = [r[0] for r in spark.range(200).select(api.sine("id", length=200, frequency=4.0)).collect()]
    assert x == pytest.approx([math.sin(2 * math.pi * 4 * 2 * k / 199) for k in range(200)])


def test_length_normalisers_take_whole_channels(spark, monkeypatch):
    from tidemark.plans import queries as registered

    sizes, seen = {0: 250, 1: 130, 2: 90}, []
    rows = [(c, t, float(1000 * c + t)) for c, n in sizes.items() for t in range(n)]
    df = spark.createDataFrame(rows, "channel int, t long, value double")
    monkeypatch.setattr(registered, "_ev", lambda s, d: df)
    monkeypatch.setattr(registered.pl, "normalise_length", lambda d, *a, f=registered.pl.normalise_length: seen.append(d.count()) or f(d, *a))
    run = lambda name: {(r.channel, r.t): r.value for r in registered.queries()[name](spark, "").collect()}
    padded, cropped = run("pl_normalise_pad_whole"), run("pl_normalise_length")
    assert seen == [len(rows)] * 2
    assert padded == {(c, t): float(1000 * c + min(t, n - 1)) for c, n in sizes.items() for t in range(270)}
    assert cropped == {(c, t): float(1000 * c + t) for c in sizes for t in range(80)}
