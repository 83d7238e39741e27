"""Planners and samplers: variants, parameters, segments and events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import draw, uniform
from ..runtime import ship
from ..sources import config as cfg
from . import stats, windows

ATTEMPTS = 2500
REJECTIONS = 512
SEGMENTS = "instance string, segment int, channel int, start long, end long"


def variants(spark: SparkSession, bases=cfg.KINDS, anomalies=cfg.ANOMALIES, profiles: int = 1, disabled=(), skip_bases=()) -> DataFrame:
    """All combinations of base, anomaly and profile with the reason why one is left out (null: it is used)."""
    b = spark.createDataFrame([(x,) for x in bases], "base string")
    a = spark.createDataFrame([(x,) for x in anomalies], "anomaly string")
    p = spark.createDataFrame([(f"p{k:02d}",) for k in range(profiles)], "profile string")
    ok = cfg.compat_frame(spark).withColumn("__ok", F.lit(True))
    grid = b.crossJoin(a).crossJoin(p).join(ok, ["anomaly", "base"], "left")
    reason = F.when(F.col("base").isin(*skip_bases), "base skipped").when(F.col("anomaly").isin(*disabled), "anomaly disabled").when(F.col("__ok").isNull(), "incompatible")
    pair = F.concat_ws("__", "base", "anomaly")
    return grid.select(F.concat_ws("__", pair, "profile").alias("variant_id"), pair.alias("pair_id"), "base", "anomaly", "profile", reason.alias("reason"))


def realise(df: DataFrame, templates: dict, seed, keys) -> DataFrame:
    """Adds a column for each template, drawn by the seed, the template's name and the keys.

    A number is itself; {min, max}, a list of two numbers and ``uniform`` {low, high} are ranges;
    ``int_uniform`` {low, high} includes both; ``choice`` {values}; ``bernoulli`` {p} is 1 or 0.
    ``reject_if_abs_lt`` draws again while the value is nearer to zero, at last the bound itself, signed.
    """
    for name, t in templates.items():
        u = lambda *more, name=name: uniform(*seed, name, *[F.col(k) for k in keys], *more)
        if isinstance(t, (int, float)):
            df = df.withColumn(name, F.lit(float(t)))
            continue
        if isinstance(t, list):
            t = {"min": t[0], "max": t[1]}
        kind = t.get("distribution", "uniform")
        lo, hi = t.get("low", t.get("min", 0)), t.get("high", t.get("max", 1))
        value = lambda x, kind=kind, lo=lo, hi=hi, t=t: _value(x, kind, lo, hi, t)
        if "reject_if_abs_lt" in t:
            bound = float(t["reject_if_abs_lt"])
            tried = F.transform(F.sequence(F.lit(0), F.lit(REJECTIONS - 1)), lambda k: value(u(k)))
            good = F.get(F.filter(tried, lambda v: F.abs(v) >= bound), F.lit(0))
            df = df.withColumn(name, F.coalesce(good, F.when(u("sign") < 0.5, -bound).otherwise(bound)))
        else:
            df = df.withColumn(name, value(u()))
    return df


def _value(u, kind, lo, hi, t):
    if kind == "int_uniform":
        return F.floor(lo + u * (hi - lo + 1)).cast("double")
    if kind == "choice":
        values = F.lit([float(v) for v in t["values"]]).cast("array<double>")
        return F.get(values, F.floor(u * len(t["values"])).cast("int"))
    if kind == "bernoulli":
        return F.when(u < t["p"], 1.0).otherwise(0.0)
    return lo + (hi - lo) * u


def realised(template, *who) -> object:
    """One template on the driver (see ``realise``); strings and booleans are themselves."""
    if isinstance(template, bool) or isinstance(template, (int, float, str)) or template is None:
        return template
    if isinstance(template, list):
        if len(template) == 2 and all(isinstance(x, (int, float)) for x in template):
            template = {"min": template[0], "max": template[1]}
        else:
            return template
    kind, lo, hi = template.get("distribution", "uniform"), template.get("low", template.get("min", 0)), template.get("high", template.get("max", 1))

    def one(u):
        if kind == "int_uniform":
            return int(lo + u * (hi - lo + 1))
        if kind == "choice":
            return template["values"][int(u * len(template["values"]))]
        if kind == "bernoulli":
            return u < template["p"]
        return lo + (hi - lo) * u

    bound = template.get("reject_if_abs_lt")
    if bound is None:
        return one(draw(*who))
    for k in range(REJECTIONS):
        if abs(v := one(draw(*who, k))) >= bound:
            return v
    return -bound if draw(*who, "sign") < 0.5 else bound


def point_events(spark: SparkSession, instances, n: int, channels: int, seed) -> DataFrame:
    """floor(density n) distinct times for each (instance, density), by smallest hash, each on a drawn channel."""
    grid = spark.createDataFrame(list(instances), "instance string, density double").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("t"))
    u = uniform(F.lit(seed), "point", F.col("instance"), F.col("t"))
    ranked = grid.withColumn("u", u).withColumn("k", F.row_number().over(Window.partitionBy("instance").orderBy("u", "t")))
    channel = F.floor(uniform(F.lit(seed), "channel", F.col("instance"), F.col("t")) * channels).cast("int")
    return ranked.where(F.col("k") <= F.floor(F.col("density") * n)).select("instance", "t", channel.alias("channel"))


def period_boundaries(spark: SparkSession, series) -> DataFrame:
    """Period starts of each (series, n, frequency), 0 and n included; only n for a period of one sample or less."""
    rows = spark.createDataFrame(list(series), "series string, n long, frequency double")
    size = 100.0 * (F.col("n") - 1) / (F.col("frequency") * F.col("n"))
    rows = rows.withColumn("size", size)
    k = F.when(F.col("size") > 1, F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / F.col("size")))).otherwise(F.array().cast("array<bigint>"))
    starts = rows.select("series", "n", F.explode(F.concat(F.transform(k, lambda j: F.bround(j * F.col("size"), 0).cast("long")), F.array("n"))).alias("t"))
    return starts.select("series", F.least(F.greatest("t", F.lit(0)), F.col("n")).alias("t")).distinct()


def frequency_ratios(spark: SparkSession, ks, offsets, low: float, high: float) -> DataFrame:
    """Ratios (k + offset) / k within bounds."""
    a, b = spark.createDataFrame([(int(k),) for k in ks], "k int"), spark.createDataFrame([(int(o),) for o in offsets], "offset int")
    return a.crossJoin(b).withColumn("ratio", (F.col("k") + F.col("offset")) / F.col("k").cast("double")).where(F.col("ratio").between(low, high))


def adapt_amplitude(df: DataFrame, min_effect: float, low: float, high: float, dead: float) -> DataFrame:
    """Factors moved away from 1 so far that the effect on a window of the given RMS reaches ``min_effect``."""
    side = F.when(F.col("factor") - 1.0 >= 0, 1.0).otherwise(-1.0)
    size = F.greatest(F.abs(F.col("factor") - 1.0), min_effect / F.greatest(F.col("rms"), F.lit(1e-9)), F.lit(dead))
    return df.withColumn("adapted", F.least(F.lit(high), F.greatest(F.lit(low), 1.0 + side * size)))


def normalise_length(df: DataFrame, length: int, keys, mode: str = "resample") -> DataFrame:
    """Samples (keys, t, value) cropped, padded with the last value or resampled to ``length``."""
    if mode == "none":
        return df
    if mode == "resample":
        return windows.resample(df, length, keys, to="value")
    if mode == "crop":
        return df.where(F.col("t") < length)
    last = df.groupBy(*keys).agg(F.max("t").alias("__l"))
    grid = last.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("t")).withColumn("__s", F.least("t", "__l"))
    return grid.join(df.withColumnRenamed("t", "__s"), [*keys, "__s"]).select(*keys, "t", "value")


# --- placement: sequential within an instance, instances in parallel ---------------------------


def proportional(total: int, minima: list[int], who) -> list[int]:
    """Whole lengths of the given total, at least the minima, the rest shared by drawn weights."""
    spare = total - sum(minima)
    u = [draw(*who, "length", k) for k in range(len(minima))]
    exact = [spare * x / sum(u) for x in u]
    out = [m + int(x) for m, x in zip(minima, exact)]
    order = sorted(range(len(minima)), key=lambda k: (int(exact[k]) - exact[k], k))
    for k in order[: total - sum(out)]:
        out[k] += 1
    return out


def free_start(busy, length: int, n: int, channels: int, who, overlap: str = "global") -> tuple[int, int]:
    """A drawn free (channel, start); after many failures the first free one in order. ValueError if there is none."""
    import numpy as np

    def free(c, s):
        rows = busy if overlap == "global" else busy[c : c + 1]
        return not rows[:, s : s + length].any()

    for k in range(ATTEMPTS):
        c, s = int(draw(*who, "channel", k) * channels), int(draw(*who, "start", k) * (n - length + 1))
        if free(c, s):
            return c, s
    for c in range(channels):
        rows = busy.any(axis=0) if overlap == "global" else busy[c]
        sums = np.concatenate(([0], np.cumsum(rows)))
        ok = np.flatnonzero(sums[length:] - sums[:-length] == 0)
        if len(ok):
            return c, int(ok[0])
    raise ValueError(f"no room for a segment of {length} samples")


def place_lengths(lengths: list[int], n: int, channels: int, who, overlap: str = "global") -> list[tuple[int, int, int]]:
    """(channel, start, end) for segments of the given lengths, in order of start, channel and length."""
    import numpy as np

    busy = np.zeros((channels, n), bool)
    out = []
    for k, m in enumerate(lengths):
        c, s = free_start(busy, m, n, channels, (*who, "segment", k), overlap)
        busy[c, s : s + m] = True
        out.append((c, s, s + m))
    return sorted(out, key=lambda x: (x[1], x[0], x[2] - x[1]))


def uniform_plan(density: float, count: int, n: int, channels: int, who, minimum: int = 5, overlap: str = "global") -> list[tuple[int, int, int]]:
    """``count`` segments (fewer if the minimum asks for it) covering round(density n) samples."""
    points = max(1, round(density * n))
    count = max(1, min(count, points // minimum))
    return place_lengths(proportional(points, [min(minimum, points)] * count, who), n, channels, who, overlap)


def _grouped(df: DataFrame, function) -> DataFrame:
    """Runs a plan for each instance's row or rows, in Python."""
    ship(df.sparkSession)

    def run(key, table):
        import pyarrow as pa

        rows = function(key[0].as_py(), table.to_pylist())
        cols = list(zip(*rows)) if rows else [[], [], []]
        return pa.table({"instance": pa.array([key[0].as_py()] * len(rows), pa.string()), "segment": pa.array(range(len(rows)), pa.int32()), "channel": pa.array(cols[0], pa.int32()), "start": pa.array(cols[1], pa.int64()), "end": pa.array(cols[2], pa.int64())})

    return df.groupBy("instance").applyInArrow(run, SEGMENTS)


def uniform_segments(spark: SparkSession, instances, n: int, channels: int, seed, minimum: int = 5, overlap: str = "global") -> DataFrame:
    """Segments for each (instance, density, count)."""
    df = spark.createDataFrame(list(instances), "instance string, density double, count int")
    return _grouped(df, lambda i, rows: uniform_plan(rows[0]["density"], rows[0]["count"], n, channels, (seed, i), minimum, overlap))


def period_segments(spark: SparkSession, series, periods: int, seed, count: int = 3) -> DataFrame:
    """Up to ``count`` disjoint segments of ``periods`` periods that begin with one, for each (series, n, frequency)."""
    bounds = period_boundaries(spark, series).withColumnRenamed("series", "instance")

    def plan(i, rows):
        at = sorted(r["t"] for r in rows)
        starts = sorted(range(len(at) - periods), key=lambda k: (draw(seed, i, "period", k), k))
        taken: list[int] = []
        for k in starts:
            if len(taken) < count and all(abs(k - x) >= periods for x in taken):
                taken.append(k)
        return [(0, at[k], at[k + periods]) for k in sorted(taken)]

    return _grouped(bounds, plan)


def energy_segments(samples: DataFrame, length: int, count: int, quantile: float, seed) -> DataFrame:
    """Up to ``count`` disjoint windows whose RMS reaches the instance's quantile; those above it are likelier (weight 1 + excess).

    Candidates are drawn by an exponential race on hashes; ``samples``: instance, channel, t, value.
    A window that is taken meets 2 length - 1 starts, itself included. So whatever stands behind the first
    (count - 1)(2 length - 1) + 1 starts of its channel, or of the instance where each start counts once, is
    never reached, and a plan's task reads no more rows than that, however long the instance is.
    """
    rms = windows.sliding_rms(samples, length, ["instance", "channel"])
    cut = stats.large_quantiles(rms, "rms", quantile, ["instance"]).withColumnRenamed("threshold", "cut")
    able = rms.join(F.broadcast(cut), "instance").where(F.col("rms") >= F.col("cut"))
    race = -F.log(uniform(F.lit(seed), "race", F.col("instance"), F.col("channel"), F.col("t"))) / (1.0 + F.col("rms") - F.col("cut"))
    able = able.select("instance", "channel", "t", race.alias("race"))
    reach = max(0, (count - 1) * (2 * length - 1) + 1)
    for keys, order, k in ((["instance", "channel"], ["race", "t"], reach), (["instance", "t"], ["race", "channel"], 1), (["instance"], ["race", "channel", "t"], reach)):
        able = able.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)

    def plan(i, rows):
        taken: list = []
        for r in sorted(rows, key=lambda r: r["place"]):
            if len(taken) == count:
                break
            if all(abs(r["t"] - x[1]) >= length for x in taken):
                taken.append((r["channel"], r["t"], r["t"] + length))
        return sorted(taken, key=lambda x: (x[1], x[0]))

    return _grouped(able, plan)


def trend_minima(frequencies: list[float], n: int, min_cycles: float, points: int) -> list[int]:
    """Least lengths for trends of the given frequencies; the largest go while they do not fit, a single one is relaxed."""
    minima = [max(5, math.ceil(100 * min_cycles / f)) for f in frequencies]
    while len(minima) > 1 and sum(minima) > points:
        minima.remove(max(minima))
    return [min(minima[0], points)] if len(minima) == 1 else minima


def trend_segments(spark: SparkSession, instances, n: int, min_cycles: float, density: float, seed, channels: int = 1) -> DataFrame:
    """Segments long enough for a share of a cycle of each one's trend, for each (instance, frequencies)."""
    df = spark.createDataFrame(list(instances), "instance string, frequencies array<double>")
    points = max(1, round(density * n))

    def plan(i, rows):
        minima = trend_minima(rows[0]["frequencies"], n, min_cycles, points)
        return place_lengths(proportional(points, minima, (seed, i)), n, channels, (seed, i))

    return _grouped(df, plan)


# --- planners of a dataset's instances: plain numbers in, (channel, start, end, attributes) out --------------------


def resolve(settings: dict, anomaly: str, special: dict | None = None, override: dict | None = None) -> dict:
    """The planner of an anomaly kind: the default, what is set for all, for the kind, in its special policy, and for the variant, later ones first."""
    out = {"planner": "point_events_from_density" if anomaly == "extremum" else "uniform_segments"}
    for more in (settings.get("default"), settings.get(anomaly), (special or {}).get("segment_planner"), override):
        out.update(more or {})
    out["planner"] = str(out["planner"]).lower()
    if out["planner"] not in PLANNERS:
        raise cfg.ConfigError(f"segment_planner: one of {', '.join(PLANNERS)} is expected for {anomaly}, not {out['planner']!r}")
    if only := {"period_locked_frequency": "frequency", "trend_parameter_aware_segments": "trend"}.get(out["planner"]):
        if anomaly != only:
            raise cfg.ConfigError(f"segment_planner: {out['planner']} is for {only} only")
    return out


PLANNERS = ("uniform_segments", "point_events_from_density", "period_locked_frequency", "energy_aware_segments", "trend_parameter_aware_segments")


def minimum_length(anomaly: str, given: dict, period: int | None = None) -> int:
    """The least length of a segment; a trend has two periods of its channel at least."""
    least = int(given.get(anomaly, 1 if anomaly in ("frequency", "extremum") else 5))
    return max(least, 2 * period) if anomaly == "trend" and period and period > 1 else least


def boundaries(n: int, frequency: float | None) -> list[int] | None:
    """Period starts of a channel, 0 and n included (see ``period_boundaries``); None if a period has one sample or less."""
    if not frequency or frequency <= 0 or n <= 1:
        return None
    size = 100.0 * (n - 1) / (frequency * n)
    if size <= 1:
        return None
    return sorted({min(max(round(k * size), 0), n) for k in range(int(n / size) + 1)} | {0, n})


def bounded(total: int, count: int, low: int, high: int, who) -> list[int]:
    """``count`` whole numbers within bounds of the given total, each spare unit given to a drawn one that has room."""
    out, spare = [low] * count, total - low * count
    k = 0
    while spare > 0:
        open_ = [j for j in range(count) if out[j] < high]
        if not open_:
            break
        out[open_[int(draw(*who, "bounded", k) * len(open_))]] += 1
        spare, k = spare - 1, k + 1
    return out


class Board:
    """What is taken: for all channels together (``global``) or each by itself."""

    def __init__(self, n: int, channels: int, overlap: str):
        import numpy as np

        self.n, self.channels, self.all = n, channels, overlap == "global"
        self.busy = np.zeros((channels, n), bool)

    def free(self, c: int, s: int, e: int) -> bool:
        rows = self.busy if self.all else self.busy[c : c + 1]
        return not rows[:, s:e].any()

    def take(self, c: int, s: int, e: int) -> None:
        self.busy[c, s:e] = True

    def starts(self, c: int, length: int):
        """Whether a segment could begin at each place of a channel."""
        import numpy as np

        rows = self.busy.any(axis=0) if self.all else self.busy[c]
        sums = np.concatenate(([0], np.cumsum(rows)))
        return sums[length:] == sums[: len(sums) - length]


def _count(bounds, who) -> int:
    low, high = sorted(map(int, bounds))
    return low + int(draw(*who, "count") * (high - low + 1))


def _sorted(plan):
    return sorted(plan, key=lambda x: (x[1], x[0], x[2] - x[1]))


def period_plan(density: float, n: int, frequencies: list, conf: dict, count_range, who, overlap: str = "global") -> list:
    """Segments of whole periods, on period starts unless ``align_to_period_start`` is off; attributes: period_count."""
    bounds = {c: b for c, f in enumerate(frequencies) if (b := boundaries(n, f))}
    if not bounds:
        raise ValueError("period_locked_frequency needs a channel with periods of more than one sample")
    counts = {c: len(b) - 1 for c, b in bounds.items()}
    sizes = sorted(n / k for k in counts.values())
    size = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
    low, high = sorted(map(int, conf.get("periods_per_segment_range", [2, 4])))
    low = max(1, low)
    high = min(max(low, high), max(counts.values()))
    if low > high:
        raise ValueError("periods_per_segment_range does not fit into the series")
    total = min(max(round(min(max(round(density * n), 1), n) / size), 1), max(counts.values()))
    low, high = min(low, total), min(high, total)
    fewest, most = -(-total // high), total // low
    a, b = max(min(count_range), fewest), min(max(count_range), most)
    if a > b:
        a, b = fewest, most
    board, out = Board(n, len(frequencies), overlap), []
    for k, periods in enumerate(bounded(total, _count((a, b), who), low, high, who)):
        able = [c for c in bounds if counts[c] >= periods]
        if not able:
            raise ValueError(f"no channel has {periods} periods")
        places = []
        for c in able:
            if conf.get("align_to_period_start", True):
                places += [(c, bounds[c][j], bounds[c][j + periods]) for j in range(counts[c] - periods + 1)]
            else:
                steps = sorted(y - x for x, y in zip(bounds[c], bounds[c][1:]))
                length = periods * steps[len(steps) // 2]
                places += [(c, s, s + length) for s in range(n - length + 1)]
        free = [p for p in places if board.free(*p)]
        if not free:
            raise ValueError(f"no room for a segment of {periods} periods")
        c, s, e = free[int(draw(*who, "period", k) * len(free))]
        board.take(c, s, e)
        out.append((c, s, e, {"period_count": periods}))
    return _sorted(out)


def _windows(values, length: int):
    """RMS and peak of every window of a channel."""
    import numpy as np

    sums = np.concatenate(([0.0], np.cumsum(values * values)))
    rms = np.sqrt(np.maximum((sums[length:] - sums[:-length]) / length, 0.0))
    return rms, np.lib.stride_tricks.sliding_window_view(np.abs(values), length).max(axis=1)


def _strength(values, c: int, s: int, e: int) -> dict:
    import numpy as np

    own = values[c][s:e]
    return {"window_rms": float(np.sqrt(np.mean(own * own))), "window_peak": float(np.abs(own).max())}


def energy_plan(values, density: float, conf: dict, count_range, minimum: int, who, overlap: str = "global") -> list:
    """Segments where a window's RMS, peak or both reach their quantiles; stronger windows are likelier.

    ``values``: the clean channels of one instance (channels x samples). Attributes: window_rms,
    window_peak, energy_metric, energy_fallback (whether a segment was placed without regard to energy).
    """
    import numpy as np

    channels, n = values.shape
    metric, fallback = str(conf.get("energy_metric", "rms")).lower(), str(conf.get("fallback", "uniform_segments")).lower()
    if metric not in ("rms", "peak", "rms_and_peak") or fallback not in ("uniform_segments", "error"):
        raise ValueError("energy_aware_segments: energy_metric is rms, peak or rms_and_peak, fallback is uniform_segments or error")
    quantiles = [float(np.clip(conf.get(k, d), 0.0, 1.0)) for k, d in (("rms_quantile", 0.6), ("peak_quantile", 0.55))]
    count = _count(count_range, who)
    points = min(max(round(density * n), count), n)
    count = max(1, min(count, points // max(1, minimum)))
    board, out = Board(n, channels, overlap), []
    for k, length in enumerate(proportional(points, [min(minimum, points)] * count, who)):
        places, weights = [], []
        for c in range(channels):
            ok, weight = board.starts(c, length), np.ones(n - length + 1)
            for name, x, q in zip(("rms", "peak"), _windows(values[c], length), quantiles):
                if name in metric:
                    cut = np.quantile(x, q)
                    ok, weight = ok & (x >= cut), weight + np.maximum(x - cut, 0.0)
            at = np.flatnonzero(ok)
            places += [(c, int(s)) for s in at]
            weights.append(weight[at] if conf.get("weighted_sampling", True) else np.ones(len(at)))
        fell = not places
        if places:
            upto = np.cumsum(np.concatenate(weights))
            c, s = places[min(int(np.searchsorted(upto, draw(*who, "energy", k) * upto[-1], side="right")), len(places) - 1)]
        elif fallback == "uniform_segments":
            c, s = free_start(board.busy, length, n, channels, (*who, "segment", k), overlap)
        else:
            raise ValueError(f"no window of {length} samples is strong enough and free")
        board.take(c, s, s + length)
        out.append((c, s, s + length, {**_strength(values, c, s, s + length), "energy_metric": metric, "energy_fallback": fell}))
    return _sorted(out)


def trend_plan(density: float, n: int, channels: int, conf: dict, count_range, minimum: int, parameters, who, overlap: str = "global", values=None) -> list:
    """Segments that are long enough for their own trends; ``parameters(k)`` draws those of segment k. Attributes: trend_params and its least length."""
    count = min(_count(count_range, who), n)
    points = min(max(round(density * n), count), n)
    cycles = float(conf.get("sine_min_cycles", 0.3))
    if cycles <= 0:
        raise ValueError("trend_parameter_aware_segments: sine_min_cycles is positive")
    rows = []
    for k in range(count):
        own, least = parameters(k), max(1, minimum)
        shape = own.get("oscillation") or {}
        if shape.get("kind") == "sine" and shape.get("frequency", 0) > 0:
            least = max(least, math.ceil(100 * cycles / shape["frequency"]))
        elif shape.get("kind") == "random-walk":
            least = max(least, int(conf.get("random_walk_min_segment_length", 8)))
        rows.append((min(least, n), own))
    while len(rows) > 1 and sum(r[0] for r in rows) > points:
        rows.remove(max(rows, key=lambda r: r[0]))
    if len(rows) == 1 and rows[0][0] > points:
        rows = [(points, rows[0][1])]
    lengths = proportional(points, [r[0] for r in rows], who)
    board, out = Board(n, channels, overlap), []
    for k, (length, (least, own)) in enumerate(zip(lengths, rows)):
        c, s = free_start(board.busy, length, n, channels, (*who, "segment", k), overlap)
        board.take(c, s, s + length)
        out.append((c, s, s + length, {"trend_params": own, "trend_min_segment_length": least, **(_strength(values, c, s, s + length) if values is not None else {})}))
    return _sorted(out)


# --- parameters of a segment ------------------------------------------------------------------------------------


def sanitise(anomaly: str, parameters: dict) -> dict:
    """Parameters within what a kind can do: lengths and floors not negative, shifts within their window and never 0, names in lower case."""
    out = dict(parameters)
    if anomaly in ("amplitude", "trend") and out.get("transition_length") is not None:
        out["transition_length"] = max(0, int(out["transition_length"]))
    if anomaly == "pattern-shift":
        window = max(1, abs(int(out.get("transition_window", 10))))
        out |= {"transition_window": window, "shift_by": max(-window, min(window, int(out.get("shift_by", 0)))) or 1}
    if anomaly == "extremum":
        out["context_window"] = max(1, abs(int(out.get("context_window", 10))))
        out |= {k: bool(out[k]) for k in ("min", "local") if k in out}
    for k in ("boundary_mode", "envelope_kind", "crossfade_mode"):
        if k in out:
            out[k] = str(out[k]).lower()
    if "min_effect_delta" in out:
        out["min_effect_delta"] = max(0.0, float(out["min_effect_delta"]))
    return out


def choose_ratio(periods: int, conf: dict, who) -> float:
    """A drawn frequency factor (k + offset) / k within bounds, so that a segment of k periods ends with one."""
    offsets = sorted({int(o) for o in conf.get("period_ratio_offsets", [-1, 1]) if int(o)})
    found = [(periods + o) / periods for o in offsets if periods + o > 0]
    if bounds := conf.get("frequency_factor_bounds"):
        found = [f for f in found if min(bounds) <= f <= max(bounds)]
    if not found:
        raise ValueError(f"no frequency factor for {periods} periods and offsets {offsets}")
    return found[int(draw(*who, "ratio") * len(found))]


def adapt_factor(factor: float, rms: float, conf: dict, index: int) -> float:
    """An amplitude factor strong enough for a weak window, out of the dead zone and within bounds."""
    least = max(0.0, float(conf.get("min_effect_delta", 0.0)))
    if conf.get("adaptive_strength") and least > 0 and rms > 1e-12 and least / rms > abs(factor - 1):
        up = factor >= 1 if abs(factor - 1) > 1e-12 else index % 2
        factor = 1 + (1 if up else -1) * least / rms
    if zone := conf.get("amplitude_factor_deadzone"):
        low, high = sorted(zone)
        if low <= factor <= high:
            factor = high if factor >= 1 else low
    if bounds := conf.get("amplitude_factor_bounds"):
        factor = min(max(factor, min(bounds)), max(bounds))
    return float(factor)


def adapt(anomaly: str, parameters: dict, attributes: dict, conf: dict, index: int, who) -> dict:
    """A segment's parameters, sanitised and fitted to what its planner found out."""
    out = sanitise(anomaly, attributes.get("trend_params") or parameters)
    if anomaly == "frequency" and "period_count" in attributes:
        out["frequency_factor"] = choose_ratio(attributes["period_count"], conf, (*who, index))
    if anomaly == "amplitude" and "amplitude_factor" in out:
        out["amplitude_factor"] = adapt_factor(float(out["amplitude_factor"]), attributes.get("window_rms", 0.0), conf, index)
    if anomaly == "trend" and conf.get("adaptive_strength") and conf.get("min_effect_delta", 0.0) > 0:
        out["min_effect_delta"] = max(float(out.get("min_effect_delta", 0.0)), float(conf["min_effect_delta"]))
    return out
