"""Base oscillations of many channels as sample rows.

Channels are rows of a small specification frame; samples come from exploding chunks of
the time index, so closed-form kinds need no shuffle and a long channel is spread over
many tasks. Sequential kinds use window functions partitioned by channel.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import oscillators as osc
from ..functions.rng import draw, normal, uniform
from ..sources.config import DEFAULTS
from . import windows

KEYS = ["series", "split", "channel", "depth"]
CHUNK = 1 << 16
ROWS_PER_TASK = 1 << 20
SPEC = (
    "series string, split string, channel int, depth int, kind string, n long, frequency double, amplitude double, freq_mod double, phase double, "
    "duty double, width double, periodicity double, complexity int, smoothing double, channel_diff double, channel_offset double, random_seed long, "
    "coefficients array<double>, avg_len long, var_len double, var_amp double, variance double, offset double, seed string"
)
NAMES = [c.strip().split(" ")[0] for c in SPEC.split(",")]


def spec_row(bo: dict, series: str, split: str, channel: int, depth: int, n: int, seed) -> tuple:
    """A channel's parameters with defaults; depth 0 is the channel itself, 1 and more its nested trends."""
    get = lambda k: DEFAULTS[k] if bo.get(k) is None else bo[k]
    amplitude = float(get("amplitude"))
    offset = bo.get("channel-offset")
    return (
        series, split, channel, depth, bo["kind"], int(n), float(get("frequency")), amplitude, float(get("freq-mod")), float(get("phase")),
        float(get("duty")), float(get("width")), float(get("periodicity")), int(get("complexity")), float(get("smoothing")), float(get("channel-diff")),
        amplitude if offset is None else float(offset), int(get("random-seed")), [float(c) for c in get("polynomial")], int(get("avg-pattern-length")),
        float(get("variance-pattern-length")), float(get("variance-amplitude")), float(get("variance")), float(get("offset")), f"{seed}|{series}|{split}",
    )


def grid(specs: DataFrame, extra: int = 0, total: int | None = None) -> DataFrame:
    """One row for each sample (and ``extra`` more at the end) of each specification."""
    n = F.col("n") + extra
    chunks = specs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(CHUNK).cast("long"))).alias("__t0"))
    if total and total > ROWS_PER_TASK:
        chunks = chunks.repartition(-(-total // ROWS_PER_TASK), *KEYS, "__t0")
    return chunks.select("*", F.explode(F.sequence(F.col("__t0"), F.least(F.col("__t0") + CHUNK, n) - 1)).alias("t")).drop("__t0")


def params(df: DataFrame) -> dict:
    """The parameter columns of a frame by name."""
    return {c: F.col(c) for c in NAMES}


def _stream(name: str):
    """What identifies a channel's own stream of draws."""
    return (F.col("seed"), F.lit(name), F.col("channel"), F.col("depth"))


def random_walk(specs: DataFrame, smoothing: float, n: int, total: int) -> DataFrame:
    taps = max(1, int(smoothing * n)) if smoothing else 1
    rows = grid(specs, taps - 1, total)
    u = uniform(*_stream("walk"), F.col("t"))
    step = F.when(F.col("t") == 0, 0.0).when(u < 1 / 3, -1.0).when(u < 2 / 3, 0.0).otherwise(1.0)
    rows = rows.withColumn("__x", windows.prefix_sum(step, KEYS))
    if smoothing:
        weights = F.lit(windows.kernel(taps)).cast("array<double>")
        rows = rows.withColumn("__x", windows.fir(F.col("__x"), weights, KEYS, taps))
    rows = rows.where(F.col("t") < F.col("n"))
    return rows.withColumn("base", windows.min_max(F.col("__x"), -F.col("amplitude"), F.col("amplitude"), KEYS)).drop("__x")


def lfsr(bits: int, taps, state) -> list[int]:
    """One period of a linear feedback shift register: its last cell is fed back, added modulo 2 to the tapped cells, and put out."""
    cells, at, out = list(state), 0, []
    taps = sorted(set(t % bits for t in taps), reverse=True)
    for _ in range(2**bits - 1):
        bit = cells[at]
        out.append(bit)
        for t in taps:
            bit ^= cells[(t + at) % bits]
        cells[at] = bit
        at = (at + 1) % bits
    return out


def mls_period(row: tuple) -> list[int]:
    """The running sum of the +-1 register output of a specification row; its draws come from the channel's stream."""
    p = dict(zip(NAMES, row))
    bits, who = p["complexity"], (p["seed"], "mls", p["channel"], p["depth"])
    count = 1 + int(draw(*who, "count") * 2)
    taps = [1 + int(draw(*who, "tap", k) * bits) for k in range(count)]
    state = [1] + [int(draw(*who, "state", k) * 2) for k in range(bits - 1)]
    total, out = 0, []
    for b in lfsr(bits, taps, state):
        total += 2 * b - 1
        out.append(total)
    return out


def mls(spark: SparkSession, rows_: list[tuple], smoothing: float, total: int) -> DataFrame:
    taps = max(1, int(smoothing * 100)) if smoothing else 1
    table = [(r[0], r[1], r[2], r[3], k, float(v)) for r in rows_ for k, v in enumerate(mls_period(r))]  # at most 2**15 - 1 for each channel
    periods = spark.createDataFrame(table, "series string, split string, channel int, depth int, __k long, __x double")
    specs = spark.createDataFrame(rows_, SPEC)
    rows = grid(specs, taps - 1, total).withColumn("__k", F.pmod(F.col("t"), (F.pow(F.lit(2.0), F.col("complexity")) - 1).cast("long")))
    rows = rows.join(periods, [*KEYS, "__k"]).drop("__k")
    if taps > 1:
        rows = rows.withColumn("__x", windows.fir(F.col("__x"), F.lit(windows.kernel(taps, 1.4)).cast("array<double>"), KEYS, taps))
    rows = rows.where(F.col("t") < F.col("n"))
    return rows.withColumn("base", windows.min_max(F.col("__x"), -F.col("amplitude"), F.col("amplitude"), KEYS)).drop("__x")


def cbf_patterns(specs: DataFrame, stream: str = "cbf") -> DataFrame:
    """The patterns of each channel: number, start, length, shape (0 bell, 1 funnel, 2 cylinder) and height, up to the first that does not fit."""
    # a gap and a pattern take one sample at least
    k = specs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    own = lambda what: (*_stream(stream), F.lit(what), F.col("k"))
    gap = F.floor(uniform(*own("gap")) * F.col("avg_len")).cast("long")
    length = F.greatest(F.lit(1), F.ceil(F.col("avg_len") + F.col("var_len") * normal(*own("length")))).cast("long")
    rows = k.withColumn("gap", gap).withColumn("length", length)
    order = Window.partitionBy(*KEYS).orderBy("k")
    before = F.coalesce(F.sum(F.col("gap") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before + F.col("gap"))
    # starts only grow, so a first misfit may still be followed by a shorter pattern that would fit
    misfit = F.max((F.col("start") + F.col("length") >= F.col("n")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    shape = F.floor(uniform(*own("shape")) * 3).cast("int")
    height = (F.col("amplitude") + F.col("var_amp") * normal(*own("height"))) * F.when(uniform(*own("sign")) > 0.5, -1.0).otherwise(1.0)
    return rows.withColumn("__misfit", misfit).where("__misfit = 0").drop("__misfit").withColumn("shape", shape).withColumn("height", height)


def cylinder_bell_funnel(specs: DataFrame, stream: str = "cbf", noise: bool = True) -> DataFrame:
    """Patterns over background noise, less the channel's own noise, which is added again later and so cancels."""
    patterns = cbf_patterns(specs, stream)
    order = Window.partitionBy(*KEYS).orderBy("start")
    after = F.coalesce(F.lead("start").over(order), F.col("n"))
    # each pattern covers the samples up to the next one; the first also those before it
    spread = patterns.withColumn("__to", after).withColumn("__from", F.when(F.lag("start").over(order).isNull(), F.lit(0)).otherwise(F.col("start")))
    covered = spread.select("*", F.explode(F.sequence(F.col("__from"), F.col("__to") - 1)).alias("t"))
    i, m = F.col("t") - F.col("start"), F.col("length").cast("double")
    inside = (i >= 0) & (i < F.col("length"))
    y = F.when(F.col("shape") == 0, F.col("height") * i / m).when(F.col("shape") == 1, F.col("height") * (m - 1 - i) / m).otherwise(F.col("height"))
    covered = covered.withColumn("base", F.when(inside, y).otherwise(0.0)).select(*NAMES, "t", "base")
    empty = grid(specs.join(patterns.select(*KEYS).distinct(), KEYS, "left_anti")).withColumn("base", F.lit(0.0)).select(*NAMES, "t", "base")
    out = covered.unionByName(empty)
    if not noise:
        return out
    own = F.when(F.col("variance") > 0, F.col("variance") * normal(*_stream(f"{stream}-noise"), F.col("t"))).otherwise(0.0)
    return out.withColumn("base", F.col("base") + own - noise_column())


def noise_column():
    """A channel's own noise: normal with a standard deviation of variance times amplitude."""
    return F.when(F.col("variance") > 0, F.col("variance") * F.col("amplitude") * normal(F.col("seed"), "noise", F.col("channel"), F.col("t"))).otherwise(0.0)


#: More kinds: name -> function from a frame of specification rows to rows with t and base (see ``register``).
REGISTERED: dict = {}


def register(kind: str, build) -> None:
    """Adds an oscillation kind. ``build`` gets the kind's specification rows (columns of SPEC) and returns them with t (0 .. n-1) and base."""
    from ..sources import config

    if kind in config.KINDS and kind not in REGISTERED:
        raise ValueError(f"{kind!r} is a built-in oscillation")
    REGISTERED[kind] = build
    config.add_kind(kind)


def samples(spark: SparkSession, specs: list[tuple]) -> DataFrame:
    """Base values of all specification rows (formulas and custom inputs excepted): parameters, t and base."""
    by: dict = {}
    for r in specs:
        p = dict(zip(NAMES, r))
        kind = p["kind"]
        if kind in osc.CLOSED:
            group = ("closed",)
        elif kind == "random-walk":
            group = (kind, p["smoothing"], p["n"])
        elif kind == "mls":
            group = (kind, p["smoothing"])
        else:
            group = (kind,)
        by.setdefault(group, []).append(r)
    parts = []
    for group, rows in by.items():
        total = sum(r[5] for r in rows)
        frame = spark.createDataFrame(rows, SPEC)
        if group[0] == "closed":
            g = grid(frame, 0, total)
            part = g.withColumn("base", osc.closed_form(F.col("t"), params(g), kinds={r[4] for r in rows}))
        elif group[0] == "ecg":
            raw = grid(frame, 0, total).withColumn("__x", osc.ecg_wave(F.col("t"), F.col("n"), F.col("frequency")))
            part = raw.withColumn("base", (F.col("__x") - F.avg("__x").over(windows.whole(KEYS))) * F.col("amplitude")).drop("__x")
        elif group[0] == "random-walk":
            part = random_walk(frame, group[1], group[2], total)
        elif group[0] == "mls":
            part = mls(spark, rows, group[1], total)
        elif group[0] == "cylinder-bell-funnel":
            part = cylinder_bell_funnel(frame)
        elif group[0] in REGISTERED:
            part = REGISTERED[group[0]](frame)
        else:
            continue
        parts.append(part.select(*NAMES, "t", "base"))
    out = parts[0] if parts else spark.createDataFrame([], SPEC + ", t long, base double")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flat_trends(bo: dict) -> list[dict]:
    """The nested trends of an oscillation, outermost first."""
    out, t = [], bo.get("trend")
    while t:
        out.append(t)
        t = t.get("trend")
    return out


def shared_noise(df: DataFrame, weight: float, seed) -> DataFrame:
    """Correlates the channels' noise: sqrt(1 - w^2) (x - mean) + w z sd + mean, with z drawn for a time and standardised.

    Nothing changes for a weight of zero or less, a single channel, or noise that does not vary.
    """
    if weight <= 0:
        return df
    w = min(1.0, weight)
    channels = df.select("series", "split", "channel").distinct().groupBy("series", "split").agg(F.count(F.lit(1)).alias("__c"))
    own = windows.whole(["series", "split", "channel"])
    rows = df.join(channels, ["series", "split"]).withColumn("__z", normal(F.lit(seed), "shared", F.col("series"), F.col("split"), F.col("t")))
    mean, sd = F.avg("noise").over(own), F.stddev_pop("noise").over(own)
    zm, zs = F.avg("__z").over(own), F.stddev_pop("__z").over(own)
    z = (F.col("__z") - zm) / F.when(zs > 1e-12, zs)
    mixed = math.sqrt(1 - w * w) * (F.col("noise") - mean) + w * z * sd + mean
    rows = rows.withColumn("__m", F.when((F.col("__c") > 1) & (sd > 1e-12), mixed))
    return rows.withColumn("noise", F.coalesce("__m", "noise")).drop("__m", "__z", "__c")
