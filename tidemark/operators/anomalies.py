"""Anomalies as rewrites of sample windows.

``inject`` takes the sample rows of any number of channels and a frame of windows.
Rows outside all windows pass through unchanged; rows inside are met by a join
on the channel with the window's bounds as residual condition, rewritten from the clean
base, and united with the rest. Up to FEW windows (the caller knows their number) are sent to all tasks,
so that only samples inside windows are shuffled; more are met by channel and span of times.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import oscillators as osc
from ..functions.rng import normal
from . import series

#: A window is one kind of one anomaly; ``order`` counts kinds over all anomalies of a series.
WINDOWS = (
    "series string, split string, channel int, anomaly int, `order` int, what string, s long, e long, creep long, factor double, transition long, lowest boolean, "
    "local boolean, context long, u double, shift_offset double, k double, cbf_factor double, square_duty double, sawtooth_width double, min_effect double, "
    "min_ptp double, adaptive boolean, blend double, shift long, shift_window long, crossfade string, value double, target double, boundary string, envelope string, "
    "tr struct<kind:string,n:bigint,frequency:double,amplitude:double,freq_mod:double,phase:double,duty:double,width:double,periodicity:double,coefficients:array<double>,seed:string,channel:int,channel_diff:double,channel_offset:double,random_seed:bigint>, "
    "own map<string,double>"
)
#: More kinds: name -> (function of the base, the place, the length and the parameters; names of the parameters).
REGISTERED: dict = {}
#: The place of a window's trend.
TREND = -2
CHANNEL = ["series", "split", "channel"]
EVENT = ["series", "split", "order"]
#: Windows that are sent to all tasks; each has some hundred bytes.
FEW = 20_000
#: Samples of a channel that look for their windows together, if there are more.
SPAN = 1 << 16
#: Kinds that need a window's samples together as arrays.
ARRAYS = ("pattern-shift", "pattern-reverse")


def window_row(series_id: str, split: str, anomaly: int, order: int, channel: int, base: dict, kind: dict, start: int, end: int, creep: int, u: float, seed) -> tuple:
    """A window from a checked kind (see ``config.normalise``)."""
    what, p = kind["kind"], kind
    get = lambda k, d=0.0: d if p.get(k) is None else p[k]
    if what == "pattern" and base["kind"] in ("mls", "ecg"):
        what = "pattern-reverse"
    trend = None
    if what == "trend" and p.get("oscillation"):
        r = dict(zip(series.NAMES, series.spec_row(p["oscillation"], series_id, split, channel, 100 + order, end - start, seed)))
        trend = tuple(r[c] for c in ("kind", "n", "frequency", "amplitude", "freq_mod", "phase", "duty", "width", "periodicity", "coefficients", "seed", "channel", "channel_diff", "channel_offset", "random_seed"))
    if what == "extremum":
        end = start + 1
    t = p.get("transition_length")
    return (
        series_id, split, channel, anomaly, order, what, start, end, creep, float(get("frequency_factor" if what == "frequency" else "amplitude_factor", 1.0)),
        None if t is None else int(t), bool(get("min", False)), bool(get("local", False)), int(get("context_window", 10)), u, float(get("offset")), float(get("sinusoid_k", 10.0)),
        float(get("cbf_pattern_factor", 2.0)), float(get("square_duty", 1.0)), float(get("sawtooth_width", 0.5)), max(0.0, float(get("min_effect_delta"))), float(get("min_window_ptp")),
        bool(get("adaptive_blend", False)), float(get("blend_strength", 1.0)), int(get("shift_by", 5)), int(get("transition_window", 10)), str(get("crossfade_mode", "cosine")).lower(),
        float(get("value")), float(get("variance")), str(get("boundary_mode", "inside_window_zero_endpoints")).lower(), str(get("envelope_kind", "sine2")).lower(), trend,
        {k: float(p[k]) for k in REGISTERED[what][1]} if what in REGISTERED else None,
    )


def half_bell(z: Column) -> Column:
    """exp(-(z / 1.05)^2 / 2)."""
    return F.exp(-F.pow(z / 1.05, F.lit(2.0)) / 2.0)


def creeping(i: Column, creep: Column) -> Column:
    """Straight ramp from 0 to 1 over the first ``creep`` samples, then 1."""
    ramp = F.when(creep > 1, i / F.greatest(creep - 1.0, F.lit(1.0))).otherwise(0.0)
    return F.when(i < creep, ramp).otherwise(1.0)


def _line(i: Column, n: Column, lo: float, hi: float) -> Column:
    """Point i of n evenly spaced ones from lo to hi (a single point is lo)."""
    return F.when(n > 1, lo + (hi - lo) * i / F.greatest(n - 1.0, F.lit(1.0))).otherwise(lo)


def amplitude_bell(i: Column, length: Column, creep: Column, factor: Column, transition: Column) -> Column:
    """What an amplitude anomaly multiplies the base with at local index i."""
    auto = F.greatest(F.lit(1), F.least(F.bround(length * 0.2).cast("long"), F.floor(length / 2).cast("long")))
    given = F.when(transition.isNotNull(), F.greatest(F.lit(0), F.least(transition, F.floor(length / 2).cast("long"))))
    t = F.coalesce(given, auto)
    low = half_bell(F.lit(-3.0))
    up, down = half_bell(_line(i, t, -3.0, 0.0)), half_bell(_line(i - (length - t), t, 0.0, 3.0))
    bell = F.when(i < t, up).when(i >= length - t, down).otherwise(1.0)
    # a ramp of one sample is as high as the plateau: the bell is constant and goes to the lower bound
    scaled = F.when((length < 3) | (t == 1), 0.0).otherwise((bell - low) / (1.0 - low))
    plain = F.when((length >= 3) & (t == 0), factor).otherwise(1.0 + (factor - 1.0) * scaled)
    rest = F.greatest(length - creep, F.lit(0))
    ones = F.bround(rest * 0.8).cast("long")
    fall = F.greatest(rest - ones, F.lit(0))
    j = i - creep - F.greatest(ones, F.lit(1))
    tail = half_bell(_line(F.least(F.greatest(j, F.lit(0)), fall - 1), fall, 0.0, 3.0))
    slow = F.when(i < creep + F.greatest(ones, F.lit(1)), creeping(i, creep)).when(fall > 0, tail).otherwise(1.0)
    return F.when(factor == 1.0, 1.0).when(creep > 0, 1.0 + (factor - 1.0) * slow).otherwise(plain)


def sinusoid(i: Column, length: Column, k: Column) -> Column:
    """atan(k u) / atan(k) over u from -1 to 1."""
    u = F.when(length > 1, -1.0 + 2.0 * i / F.greatest(length - 1.0, F.lit(1.0))).otherwise(0.0)
    return F.when(F.abs(k) < 1e-8, u).otherwise(F.atan(k * u) / F.atan(F.when(F.abs(k) >= 1e-8, k)))


# --- elementwise kinds ------------------------------------------------------------------


def _rewritten(inside: DataFrame, scales: DataFrame | None, kinds: set[str], bases: set[str], trends: set[str]) -> DataFrame:
    """Adds the new base (nb), new noise (nn), the trend switched off (tz) and trend added (ta) to window rows.

    Only what the occurring kinds need becomes part of the plan.
    """
    w = Window.partitionBy(*EVENT)
    ends = Window.partitionBy(*EVENT).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x, what = F.col("base"), F.col("what")
    i, n = F.col("i").cast("double"), F.col("len").cast("double")
    p = series.params(inside)
    alpha = F.when(n > 1, i / F.greatest(n - 1.0, F.lit(1.0))).otherwise(0.0)
    creep = creeping(i, F.col("creep").cast("double"))
    null = F.lit(None).cast("double")
    rows, base, noise, trend = inside, [], null, null
    if "amplitude" in kinds:
        base.append(("amplitude", x * amplitude_bell(i, n, F.col("creep").cast("double"), F.col("factor"), F.col("transition"))))
    if "mean" in kinds:
        base.append(("mean", x + F.col("shift_offset") * creep))
    if "mode-correlation" in kinds:
        base.append(("mode-correlation", -x))
    if "frequency" in kinds:
        # the same oscillation, faster, in phase at the start; then its ends are tied to the clean ones
        f = F.col("frequency") * F.col("factor")
        phase = osc.theta(F.col("s"), F.col("n"), F.col("frequency")) - osc.theta(F.col("s"), F.col("n"), f)
        fast = osc.closed_form(F.col("t"), p, frequency=f, phase=phase, kinds=bases)
        if "ecg" in bases:
            fast = F.when(F.col("kind") == "ecg", osc.ecg_wave(F.col("t"), F.col("n"), f) * F.col("amplitude")).otherwise(fast)
        rows = rows.withColumn("fast", F.when(what == "frequency", fast))
        left, right = F.first(x - F.col("fast")).over(ends), F.last(x - F.col("fast")).over(ends)
        base.append(("frequency", F.when(n <= 1, x).otherwise(F.col("fast") + (1.0 - alpha) * left + alpha * right)))
    if "pattern" in kinds:
        # another shape for square and sawtooth, else a blend towards a steep sinusoid
        scale = F.greatest((F.max(x).over(w) - F.min(x).over(w)) / 2.0, F.col("min_ptp") / 2.0, F.lit(1e-6))
        rows = rows.withColumn("aim", F.when(what == "pattern", F.avg(x).over(w) + scale * sinusoid(i, n, F.col("k")) - x))
        rows = rows.withColumn("reach", F.max(F.abs("aim")).over(w))
        reach = F.col("reach")
        blend = F.when(F.col("adaptive") & (F.col("min_effect") > 0) & (reach > 1e-12), F.greatest(F.col("blend"), F.col("min_effect") / F.when(reach > 1e-12, reach))).otherwise(F.col("blend"))
        mixed = x + blend * F.col("aim")
        cand = F.when(F.col("kind") == "cylinder-bell-funnel", F.col("alt")).otherwise(mixed)
        if shaped := bases & {"square", "sawtooth"}:
            other = osc.closed_form(F.col("t"), p, duty=F.col("square_duty"), width=F.col("sawtooth_width"), kinds=shaped)
            cand = F.when(F.col("kind").isin(*shaped), other).otherwise(cand)
        rows = rows.withColumn("cand", F.when(what == "pattern", cand))
        least = F.greatest(F.col("min_effect"), F.lit(1e-10))
        nudged = F.col("cand") + F.when(F.col("i") == 0, least).otherwise(0.0)
        effect = F.max(F.abs(F.col("cand") - x)).over(w)
        base.append(("pattern", F.when(effect >= least, F.col("cand")).when(reach <= 1e-12, nudged).otherwise(mixed)))
    if "platform" in kinds:
        # pushed away from the median until the peak effect is large enough
        rows = rows.withColumn("x_med", F.median(x).over(w))
        peak = F.greatest(F.abs(F.col("value") - F.min(x).over(w)), F.abs(F.col("value") - F.max(x).over(w)))
        side = F.when(F.col("value") - F.col("x_med") >= 0, 1.0).otherwise(-1.0)
        base.append(("platform", F.when((F.col("min_effect") > 0) & (peak < F.col("min_effect")), F.col("value") + side * (F.col("min_effect") - peak)).otherwise(F.col("value"))))
    if scales is not None:
        # extremum: sized by the range of the base (or of the context) and the noise
        rows = rows.join(scales, EVENT, "left")
        sized = F.when(F.col("local"), F.col("u") * F.col("ctx_range")).otherwise((F.col("u") + 0.5) * F.col("all_range"))
        sized = F.when(sized < 2.0 * F.col("max_noise"), sized + 2.0 * F.col("max_noise")).otherwise(sized)
        base.append(("extremum", x + F.when(F.col("lowest"), -1.0).otherwise(1.0) * sized))
    if "variance" in kinds:
        # new noise with a scale relative to the window
        cbf = F.col("kind") == "cylinder-bell-funnel"
        base.append(("variance", F.when(cbf, F.col("alt"))))
        ref = F.greatest(F.stddev_pop(x).over(w), 0.25 * F.abs("amplitude"), F.lit(1e-6))
        target, own = F.greatest(F.lit(0.0), F.col("target") * ref), F.greatest(F.lit(0.0), F.col("variance") * ref)
        schedule = F.greatest(F.lit(0.0), creep * (target - own) + own)
        fresh = normal(F.col("seed"), "variance", F.col("order"), F.col("t")) * schedule
        rows = rows.withColumn("fresh", F.when((what == "variance") & ~cbf, F.when(target <= 0, 0.0).otherwise(fresh)))
        rows = rows.withColumn("far", F.max(F.abs(F.col("fresh") - F.col("noise"))).over(w))
        far = F.col("far")
        impulse = F.when(F.col("i") == F.floor(n / 2), F.when(F.col("u") < 0.5, -1.0).otherwise(1.0) * F.col("min_effect")).otherwise(0.0)
        small = (F.col("min_effect") > 0) & (F.col("target") > 0) & (far < F.col("min_effect"))
        scaled = F.when(far > 1e-12, F.col("noise") + (F.col("fresh") - F.col("noise")) * F.col("min_effect") / F.when(far > 1e-12, far)).otherwise(F.col("noise") + impulse)
        noise = F.when(small, scaled).otherwise(F.col("fresh"))
    if "trend" in kinds:
        # a local oscillation without its chord, under an envelope
        tr = {c: F.col(f"tr.{c}") for c in ("kind", "n", "frequency", "amplitude", "freq_mod", "phase", "duty", "width", "periodicity", "coefficients", "seed", "channel", "channel_diff", "channel_offset", "random_seed")}
        carried = F.col("boundary") == "legacy_carry_over"
        li = F.when(carried, F.least(F.col("i"), F.col("len") - 1)).otherwise(F.col("i"))
        rows = rows.withColumn("local_trend", F.when(what == "trend", F.coalesce("walk", osc.closed_form(li, tr, kinds=trends))))
        flat = F.col("local_trend") - ((1.0 - alpha) * F.first("local_trend").over(ends) + alpha * F.last("local_trend").over(ends))
        tlen = F.coalesce(F.when(F.col("transition").isNotNull(), F.greatest(F.lit(0), F.least(F.col("transition"), F.col("len")))), F.greatest(F.lit(1), F.least(F.bround(n * 0.2).cast("long"), F.col("len"))))
        low = half_bell(F.lit(-3.0))
        rise = F.when(li < tlen, half_bell(_line(li.cast("double"), tlen, -3.0, 0.0))).otherwise(1.0)
        rise = F.when(tlen == 0, 1.0).when(tlen == 1, 0.0).otherwise((rise - low) / (1.0 - low))
        shaped_t = F.when(F.col("envelope").isin("sine2", "sin2") & (n > 1), flat * F.pow(F.sin(math.pi * alpha), F.lit(2.0))).when(F.col("envelope") == "transition", flat * rise).otherwise(flat)
        rows = rows.withColumn("shaped", F.when(what == "trend", F.when(n == 1, 0.0).otherwise(shaped_t)))
        top, bump = F.max(F.abs("shaped")).over(w), F.sin(math.pi * alpha)
        rows = rows.withColumns({"top": top, "bump_top": F.max(bump).over(w)})
        top, bump_top = F.col("top"), F.col("bump_top")
        raised = F.when(top >= F.col("min_effect"), F.col("shaped")).when(top > 1e-12, F.col("shaped") * F.col("min_effect") / F.when(top > 1e-12, top)).when(n == 1, F.col("min_effect"))
        raised = raised.when(bump_top > 1e-12, F.col("min_effect") / F.when(bump_top > 1e-12, bump_top) * bump).otherwise(F.col("shaped"))
        own_trend = F.when(carried, F.col("local_trend") * rise).when(F.col("min_effect") > 0, raised).otherwise(F.col("shaped"))
        trend = F.when(what == "trend", own_trend)
    for k in sorted(kinds & set(REGISTERED)):
        rewrite, names = REGISTERED[k]
        base.append((k, rewrite(x, F.col("i"), F.col("len"), {c: F.try_element_at("own", F.lit(c)) for c in names})))
    new = null
    for k, y in reversed(base):
        new = F.when(what == k, y).otherwise(new)
    return rows.withColumns({"nb": new, "nn": noise, "tz": what == "platform", "ta": trend})


# --- kinds on arrays --------------------------------------------------------------------


def _shifted(xs: Column, shift: Column, window: Column, crossfade: Column) -> Column:
    """The window rolled by ``shift``, its ends faded into the clean ones and pinned to them."""
    n = F.size(xs)
    simple = (window <= 1) | (n <= 2 * window) | (shift == 0)
    fade = lambda j: F.when(crossfade == "linear", _line(j.cast("double"), window, 0.0, 1.0)).otherwise(0.5 * (1.0 - F.cos(_line(j.cast("double"), window, 0.0, math.pi))))

    def at(x, i):
        moved = F.get(xs, F.pmod(i - shift, n).cast("int"))
        edge = F.when(simple | ((i >= window) & (i < n - window)), 1.0).when(i < window, fade(i)).otherwise(fade(n - 1 - i))
        return F.when((i == 0) | (i == n - 1), x).otherwise((1.0 - edge) * x + edge * moved)

    return F.transform(xs, at)


def _effect(ys: Column, xs: Column) -> Column:
    return F.array_max(F.zip_with(ys, xs, lambda a, b: F.abs(a - b)))


def shift_windows(events: DataFrame) -> DataFrame:
    """Pattern shifts of windows given as arrays ``xs``: adds ``ys``.

    A shift without any effect is replaced by the first of a few others that has one; if the
    effect is too small, the best shift in reach is taken, then scaled up to the floor.
    """
    xs, n = F.col("xs"), F.size("xs")
    w = F.least(F.col("shift_window"), F.greatest(F.lit(1), F.floor(n / 2))).cast("int")
    s = F.greatest(-w, F.least(w, F.col("shift").cast("int")))
    s = F.when(s == 0, 1).otherwise(s)
    rows = events.withColumns({"w": w, "s0": s})
    tried = lambda shift: F.struct(_effect(_shifted(xs, shift, F.col("w"), F.col("crossfade")), xs).alias("e"), _shifted(xs, shift, F.col("w"), F.col("crossfade")).alias("y"))
    rows = rows.withColumn("r0", tried(F.col("s0")))
    others = F.filter(F.array(F.lit(1), F.lit(-1), F.lit(2), F.lit(-2), F.col("w"), -F.col("w")), lambda c: (c != 0) & (F.abs(c) < n) & (c != F.col("s0")))
    found = F.filter(F.transform(others, tried), lambda r: r["e"] > 1e-10)
    rows = rows.withColumn("r1", F.when((F.col("r0.e") <= 1e-10) & (F.size(found) > 0), F.get(found, F.lit(0))).otherwise(F.col("r0")))
    most = F.least(n - 1, F.greatest(F.lit(1), F.col("w")))
    all_ = F.filter(F.sequence(-most, most), lambda c: c != 0)
    ranked = F.array_max(F.transform(all_, lambda c: F.struct(_effect(_shifted(xs, c, F.col("w"), F.col("crossfade")), xs).alias("e"), (-c).alias("c"))))
    rows = rows.withColumn("best", F.when((F.col("min_effect") > 0) & (F.col("r1.e") < F.col("min_effect")), ranked))
    rows = rows.withColumn("r2", F.when(F.col("best.e") > F.col("r1.e"), tried(-F.col("best.c"))).otherwise(F.col("r1")))
    e, y, floor = F.col("r2.e"), F.col("r2.y"), F.col("min_effect")
    up = F.transform(F.zip_with(y, xs, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p, i: F.when((i == 0) | (i == n - 1), p["b"]).otherwise(p["b"] + (p["a"] - p["b"]) * floor / F.when(e > 1e-12, e)))
    mid = F.floor(n / 2).cast("int")
    pulse = F.transform(xs, lambda x, i: x + F.when((i == 0) | (i == n - 1), 0.0).when(i == mid, floor).when((i == mid - 1) | (i == mid + 1), -0.5 * floor).otherwise(0.0))
    force = F.least(F.greatest(F.lit(1), mid), n - 1)
    forced = F.transform(y, lambda x, i: x + F.when(i == force, 1e-3).otherwise(0.0))
    ys = F.when((floor > 0) & (e < floor), F.when(e > 1e-12, up).otherwise(pulse)).when(e <= 1e-10, forced).otherwise(y)
    return rows.withColumn("ys", F.when(n <= 1, xs).otherwise(ys)).drop("w", "s0", "r0", "r1", "r2", "best")


def reverse_windows(events: DataFrame) -> DataFrame:
    """Time-reversed windows of mls (with interpolated seams) and ecg (from a local maximum): adds ``ys``.

    ``around`` holds the samples from ``a0`` on, a little more than the window.
    """
    xs, n = F.col("xs"), F.size("xs")
    tw = F.floor(0.1 * n).cast("int")
    tw = tw - tw % 2
    back = F.reverse(xs)

    def seam(first, second, j):
        pair = F.concat(first, second)
        at = F.least(2.0 * tw * j / F.greatest(tw - 1, F.lit(1)), 2.0 * tw - 1.0)
        lo = F.floor(at).cast("int")
        a, b = F.get(pair, lo), F.get(pair, F.least(lo + 1, 2 * tw - 1))
        return a + (at - lo) * (b - a)

    head, tail = F.slice(xs, F.lit(1), F.greatest(tw, F.lit(1))), F.slice(back, F.lit(1), F.greatest(tw, F.lit(1)))
    head_end, tail_end = F.slice(back, n - F.greatest(tw, F.lit(1)) + 1, F.greatest(tw, F.lit(1))), F.slice(xs, n - F.greatest(tw, F.lit(1)) + 1, F.greatest(tw, F.lit(1)))
    seamed = F.transform(back, lambda x, i: F.when(i < tw, seam(head, tail, i)).when(i >= n - tw, seam(head_end, tail_end, i - (n - tw))).otherwise(x))
    mls = F.when((tw < 2) | (n < 4) | (2 * tw >= n), back).otherwise(seamed)
    width = F.greatest(F.lit(1), F.floor(n * 0.05)).cast("int")
    at = lambda k: F.col("s") + k - F.col("a0")

    def starts(k):
        lo = F.greatest(at(k), -F.col("a0")).cast("int")
        part = F.slice("around", lo + 1, width)
        return (F.size(part) > 0) & (F.array_position(part, F.array_max(part)) == 1)

    slide = F.coalesce(F.get(F.filter(F.sequence(F.lit(-3), F.lit(2)), starts), F.lit(0)), F.lit(0))
    begin = F.greatest(F.lit(0).cast("long"), F.least(F.col("s") + slide, F.col("n") - n))
    ecg = F.reverse(F.slice("around", (begin - F.col("a0")).cast("int") + 1, n))
    rows = events.withColumn("cand", F.when(F.col("kind") == "mls", mls).otherwise(ecg))
    effect, least = _effect(F.col("cand"), xs), F.greatest(F.col("min_effect"), F.lit(1e-10))
    lo, hi = F.array_min(xs), F.array_max(xs)
    mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
    scale = F.greatest((hi - lo) / 2.0, F.col("min_ptp") / 2.0, F.lit(1e-6))
    aim = F.transform(xs, lambda x, i: mean + scale * sinusoid(i.cast("double"), n.cast("double"), F.col("k")) - x)
    reach = F.array_max(F.transform(aim, lambda a: F.abs(a)))
    blend = F.when(F.col("adaptive") & (F.col("min_effect") > 0), F.greatest(F.col("blend"), F.col("min_effect") / F.when(reach > 1e-12, reach))).otherwise(F.col("blend"))
    mixed = F.zip_with(xs, aim, lambda x, a: x + blend * a)
    nudged = F.transform("cand", lambda x, i: x + F.when(i == 0, least).otherwise(0.0))
    return rows.withColumn("ys", F.when(effect >= least, F.col("cand")).when(reach <= 1e-12, nudged).otherwise(mixed)).drop("cand")


# --- the whole ----------------------------------------------------------------------------


def _met(rows: DataFrame, windows: DataFrame, few: bool, before=0, after=0, to_end=None) -> DataFrame:
    """Samples with the windows they lie in, widened by ``before`` and ``after`` samples; windows marked ``to_end`` reach the end of their channel."""
    start, end = F.col("s") - before, F.col("e") + after
    inside = (F.col("t") >= start) & ((F.col("t") < end) if to_end is None else ((F.col("t") < end) | to_end))
    if few:
        return rows.join(F.broadcast(windows), CHANNEL).where(inside)
    own = windows if to_end is None else windows.where(~to_end)
    own = own.withColumn("__span", F.explode(F.sequence(F.floor(start / SPAN), F.floor((end - 1) / SPAN))))
    out = rows.withColumn("__span", F.floor(F.col("t") / SPAN)).join(own, [*CHANNEL, "__span"]).where(inside).drop("__span")
    return out if to_end is None else out.unionByName(rows.join(windows.where(to_end), CHANNEL).where(inside))


def inject(rows: DataFrame, windows: DataFrame, kinds: set[str], bases: set[str], trends: set[str] = frozenset(), alternatives: DataFrame | None = None, walks: DataFrame | None = None, few: bool = True) -> DataFrame:
    """Applies windows to sample rows (parameters, t, base, noise, trend, offset).

    Anomalies overwrite the base, and of several at one sample the last wins; kinds of one
    anomaly are summed. Noise is replaced by the last variance kind; a platform switches the
    trend off, and what trend kinds after it add stays. ``kinds``, ``bases`` and ``trends``: the anomaly
    kinds, base kinds and kinds of local trends that occur. ``alternatives`` (series, split, order, t, alt) and ``walks`` (series, split, order, i, walk) give
    regenerated patterns and sequential trends. Samples without a window pass unchanged. ``few``: whether there are at most FEW windows.
    """
    cover = windows.select(*CHANNEL, "s", F.when((F.col("what") == "trend") & (F.col("boundary") == "legacy_carry_over"), F.lit(2**62)).otherwise(F.col("e")).alias("e"))
    spans = cover.groupBy(*CHANNEL).agg(F.collect_list(F.struct("s", "e")).alias("__spans"))
    marked = rows.join(F.broadcast(spans) if few else spans, CHANNEL, "left")
    covered = F.exists("__spans", lambda w: (F.col("t") >= w["s"]) & (F.col("t") < w["e"]))
    plain = marked.where(~F.coalesce(covered, F.lit(False))).drop("__spans")
    keep = [*rows.columns]
    to_end = (F.col("what") == "trend") & (F.col("boundary") == "legacy_carry_over")
    single = windows.where(~F.col("what").isin(*ARRAYS))
    inside = _met(rows, single, few, to_end=to_end if "trend" in kinds else None)
    inside = inside.withColumn("i", F.col("t") - F.col("s")).withColumn("len", F.col("e") - F.col("s"))
    inside = inside.join(alternatives, [*EVENT, "t"], "left") if alternatives is not None else inside.withColumn("alt", F.lit(None).cast("double"))
    if walks is not None:
        inside = inside.withColumn("__i", F.least(F.col("i"), F.col("len") - 1)).join(walks.withColumnRenamed("i", "__i"), [*EVENT, "__i"], "left").drop("__i")
    else:
        inside = inside.withColumn("walk", F.lit(None).cast("double"))
    scales = _scales(rows, windows, few) if "extremum" in kinds else None
    changes = _rewritten(inside, scales, kinds, bases, trends).select(*keep, "anomaly", "order", "nb", "nn", "tz", "ta")
    if kinds & set(ARRAYS):
        changes = changes.unionByName(_array_changes(rows, windows.where(F.col("what").isin(*ARRAYS)), keep, few))
    per = changes.groupBy(*CHANNEL, "t", "anomaly").agg(
        F.sum("nb").alias("nb"),
        F.max(F.when(F.col("nn").isNotNull(), F.struct("order", "nn"))).alias("nn"),
        F.max(F.when(F.col("tz"), F.col("order"))).alias("off"),
        F.collect_list(F.when(F.col("ta").isNotNull(), F.struct("order", "ta"))).alias("adds"),
        *[F.first(c).alias(c) for c in keep if c not in (*CHANNEL, "t")],
    )
    final = per.groupBy(*CHANNEL, "t").agg(
        F.max(F.when(F.col("nb").isNotNull(), F.struct("anomaly", "nb"))).alias("nb"),
        F.max("nn").alias("nn"),
        F.max("off").alias("off"),
        F.flatten(F.collect_list("adds")).alias("adds"),
        *[F.first(c).alias(c) for c in keep if c not in (*CHANNEL, "t")],
    )
    added = F.aggregate(F.filter("adds", lambda a: a["order"] > F.coalesce(F.col("off"), F.lit(-1))), F.lit(0.0), lambda acc, a: acc + a["ta"])
    final = final.withColumns(
        {"base": F.coalesce(F.col("nb.nb"), F.col("base")), "noise": F.coalesce(F.col("nn.nn"), F.col("noise")), "trend": F.when(F.col("off").isNull(), F.col("trend")).otherwise(0.0) + added}
    )
    return plain.select(*keep).unionByName(final.select(*keep))


def _scales(rows: DataFrame, windows: DataFrame, few: bool) -> DataFrame:
    """For each extremum: the base's range, the range around it and the largest noise. Channels are reduced once, whatever the number of their windows."""
    ext = windows.where("what = 'extremum'").select(*EVENT, "channel", "s", "e", "context")
    at = F.broadcast(ext.select(*CHANNEL).distinct()) if few else ext.select(*CHANNEL).distinct()
    whole = rows.join(at, CHANNEL, "left_semi").groupBy(*CHANNEL).agg((F.max("base") - F.min("base")).alias("all_range"), F.max(F.abs("noise")).alias("max_noise"))
    half = F.floor(F.col("context") / 2)
    near = _met(rows.select(*CHANNEL, "t", "base"), ext, few, half, half)
    spread = near.groupBy(*EVENT).agg((F.max("base") - F.min("base")).alias("ctx_range"))
    return ext.select(*EVENT, "channel").join(whole, CHANNEL).join(spread, EVENT).drop("channel")


def _array_changes(rows: DataFrame, windows: DataFrame, keep: list[str], few: bool) -> DataFrame:
    reach = F.when(F.col("what") == "pattern-reverse", 3 + F.greatest(F.lit(1), F.floor((F.col("e") - F.col("s")) * 0.05))).otherwise(0)
    near = _met(rows, windows, few, reach, reach)
    names = [c for c in keep if c not in ("t", "base", "noise", "trend", *CHANNEL)]
    wins = [c for c in windows.columns if c not in (*CHANNEL, "order")]
    events = near.groupBy(*CHANNEL, "order").agg(
        F.sort_array(F.collect_list(F.struct("t", "base", "noise", "trend"))).alias("all"), *[F.first(c).alias(c) for c in (*names, *wins)]
    )
    events = events.withColumn("a0", F.get("all", F.lit(0))["t"]).withColumn("around", F.transform("all", lambda x: x["base"]))
    events = events.withColumn("own", F.filter("all", lambda x: (x["t"] >= F.col("s")) & (x["t"] < F.col("e")))).withColumn("xs", F.transform("own", lambda x: x["base"]))
    shift = shift_windows(events.where("what = 'pattern-shift'"))
    back = reverse_windows(events.where("what = 'pattern-reverse'"))
    both = shift.select(*back.columns).unionByName(back)
    zipped = both.withColumn("z", F.explode(F.zip_with("own", "ys", lambda a, b: F.struct(a["t"].alias("t"), a["base"].alias("base"), a["noise"].alias("noise"), a["trend"].alias("trend"), b.alias("nb")))))
    out = zipped.select(*[c for c in keep if c not in ("t", "base", "noise", "trend")], "z.t", "z.base", "z.noise", "z.trend", "anomaly", "order", "z.nb")
    return out.select(*keep, "anomaly", "order", "nb", F.lit(None).cast("double").alias("nn"), F.lit(False).alias("tz"), F.lit(None).cast("double").alias("ta"))
