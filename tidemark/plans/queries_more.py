"""More registered queries: positions, planners, reversed and regenerated windows, floors of effects, data sets and scenarios."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import planner as pl
from ..operators import windows as win
from ..sources import tables
from .dataset import Dataset
from .engine import Engine
from .queries import _EV, _K, _SIN, N, SEED, _an, _engine, _ev, _ints, _key, _single, add, lit, q6, r6, sql_normal, sql_theta, sql_uniform

# --- maximum length sequences and windows played backwards ---------------------------------------------------

_bit = lambda what, *k: sql_uniform(_key, "'mls'", "0", "0", f"'{what}'", *k)
#: A register of five cells that feeds back its last cell, added modulo 2 to the tapped ones; its running sum repeats after 31 steps.
_MLS = f"""recursive taps as (select list(distinct tap) as taps from (select (1 + cast(floor({_bit('tap', 'range')} * 5) as int)) % 5 as tap from range(2) where range < 1 + floor({_bit('count')} * 2))),
reg as (
  select 0 as k, 0 as place, null::int as bit, list_transform(range(5), lambda i: case when i = 0 then 1 else cast(floor({_bit('state', 'i - 1')} * 2) as int) end) as cells
  union all
  select k + 1, (place + 1) % 5, cells[place + 1], list_transform(range(5), lambda i: case when i = place then (cells[place + 1] + list_sum(list_transform(taps, lambda x: cells[(x + place) % 5 + 1]))) % 2 else cells[i + 1] end)
  from reg, taps where k < 31),
steps as (select k - 1 as k, sum(2 * bit - 1) over (order by k) as x from reg where bit is not null),
walk as (select range as t, x from range({N} + 4) join steps on steps.k = range % 31),
smooth as (select t, {' + '.join(f'lead(x, {j}) over (order by t) * {lit(win.kernel(5, 1.4)[4 - j])}' for j in range(5))} as y from walk),
g as (select t, (y - min(y) over ()) / (max(y) over () - min(y) over ()) * 2 - 1 as x from smooth where t < {N})"""
_MLS_CHANNEL = {"kind": "mls", "complexity": 5, "smoothing": 0.05}
add("bo_mls", _engine(_single(_MLS_CHANNEL)), f"with {_MLS} select 0 as channel, t, {q6('x')} as value, 0 as is_anomaly from g")
#: The seams of a window of 60 samples: six samples of the clean end and of the reversed one, read at half the pace.
_seam = lambda a, b, j: f"(list_concat({a}, {b})[cast(floor(least(12 * ({j}) / 5.0::DOUBLE, 11)) as int) + 1] + (least(12 * ({j}) / 5.0::DOUBLE, 11) - floor(least(12 * ({j}) / 5.0::DOUBLE, 11))) * (list_concat({a}, {b})[least(cast(floor(least(12 * ({j}) / 5.0::DOUBLE, 11)) as int) + 1, 11) + 1] - list_concat({a}, {b})[cast(floor(least(12 * ({j}) / 5.0::DOUBLE, 11)) as int) + 1]))"
add("an_pattern_mls", _engine(_single(_MLS_CHANNEL, [_an([{"kind": "pattern"}])])),
    f"""with {_MLS}, l as (select list(x order by t) as xs, list(x order by t desc) as back from g where t >= 300 and t < 360)
select 0 as channel, t, {q6(f"case when t < 300 or t >= 360 then x when t < 306 then {_seam('xs[1:6]', 'back[1:6]', 't - 300')} when t >= 354 then {_seam('back[55:60]', 'xs[55:60]', 't - 354')} else back[t - 299] end")} as value, case when t >= 300 and t < 360 then 1 else 0 end as is_anomaly from g, l""")  # fmt: skip
add("an_pattern_reverse_ecg", _engine(_single({"kind": "ecg", "frequency": 3}, [_an([{"kind": "pattern"}])])),
    f"""with r as (select range as t, 0.1::DOUBLE * sin(p) + pow(greatest(0.0::DOUBLE, sin(2 * p)), 6) + 0.2::DOUBLE * sin(p + {lit(math.pi / 4)}) as v from (select range, {lit(2 * math.pi * 3)} * range / {lit(N)} as p from range({N}))),
g as (select t, v - avg(v) over () as x from r), l as (select list(x order by t) as xs from g),
b as (select xs, 300 + coalesce(list_filter(range(-3, 3), lambda k: list_max(xs[300 + k + 1 : 300 + k + 3]) = xs[300 + k + 1])[1], 0) as begin from l)
select 0 as channel, t, {q6('case when t >= 300 and t < 360 then xs[begin + 59 - (t - 300) + 1] else x end')} as value, case when t >= 300 and t < 360 then 1 else 0 end as is_anomaly from g, b""")  # fmt: skip


def _cbf(stream: str, length: float, deviation: float, height: float, spread: float) -> str:
    """Tables h (patterns that fit) and g (t, x) of a cylinder-bell-funnel channel; names end with the stream's letter."""
    key = lambda what, k="k": sql_uniform(_key, f"'{stream}'", "0", "0", f"'{what}'", k)
    nkey = lambda what: sql_normal(_key, f"'{stream}'", "0", "0", f"'{what}'", "k")
    z = stream[-1]
    return f"""p{z} as (select range as k, cast(floor({key('gap', 'range')} * {length}) as bigint) as gap from range({N})),
l{z} as (select k, gap, greatest(1, cast(ceil({length} + {deviation} * {nkey('length')}) as bigint)) as len from p{z}),
s{z} as (select *, coalesce(sum(gap + len) over (order by k rows between unbounded preceding and 1 preceding), 0) + gap as start from l{z}),
o{z} as (select *, max(case when start + len >= {N} then 1 else 0 end) over (order by k rows unbounded preceding) as bad from s{z}),
h{z} as (select *, floor({key('shape')} * 3) as shape, ({height} + {spread}::DOUBLE * {nkey('height')}) * case when {key('sign')} > 0.5::DOUBLE then -1 else 1 end as height from o{z} where bad = 0),
g{z} as (select t, coalesce(case when shape = 0 then height * (t - start) / len when shape = 1 then height * (len - 1 - (t - start)) / len else height end, 0.0::DOUBLE) as x
  from (select range as t from range({N})) a left join h{z} on a.t >= h{z}.start and a.t < h{z}.start + h{z}.len)"""


add("an_pattern_cbf", _engine(_single({"kind": "cylinder-bell-funnel", "avg-pattern-length": 20, "variance-pattern-length": 2}, [_an([{"kind": "pattern"}], length=200)])),
    f"""with {_cbf('cbf', 20, 2, 1, 2)}, {_cbf('cbf-0', 20, 4, 1, 2)}
select 0 as channel, t, {q6('case when t >= 300 and t < 500 then g0.x else gf.x end')} as value, case when t >= 300 and t < 500 then 1 else 0 end as is_anomaly from gf join g0 using (t)""")  # fmt: skip

# --- floors of effects -------------------------------------------------------------------------------------------

_th = sql_theta(N, 5)


def _floor(inside: str) -> str:
    return f"""with g as (select range as t, sin({sql_theta(N, 5, 'range')}) as x from range({N})), y as (select t, t - 300 as i, x from g where t >= 300 and t < 360), {inside}
select 0 as channel, g.t, {q6('coalesce(z.v, g.x)')} as value, case when g.t >= 300 and g.t < 360 then 1 else 0 end as is_anomaly from g left join z on g.t = z.t"""


_aim = f"(select t, x, avg(x) over () + (max(x) over () - min(x) over ()) / 2 * atan(10 * (-1 + 2.0::DOUBLE * i / 59)) / {lit(math.atan(10))} - x as aim from y)"
add("an_pattern_min_effect", _engine(_single(_SIN, [_an([{"kind": "pattern", "blend_strength": 0.1, "adaptive_blend": True, "min_effect_delta": 0.9}])])),
    _floor(f"z as (select t, x + greatest(0.1::DOUBLE, 0.9::DOUBLE / max(abs(aim)) over ()) * aim as v from {_aim})"))
_chord = f"0.1::DOUBLE * sin({sql_theta(60, 3, 'i')}) - (i / 59.0::DOUBLE) * 0.1::DOUBLE * sin({sql_theta(60, 3, '59')})"
add("an_trend_min_effect", _engine(_single(_SIN, [_an([{"kind": "trend", "oscillation": {"kind": "sine", "frequency": 3, "amplitude": 0.1}, "min_effect_delta": 1.5}])])),
    _floor(f"s as (select t, x, ({_chord}) * pow(sin({lit(math.pi)} * i / 59), 2) as s from y), z as (select t, x + s * 1.5::DOUBLE / max(abs(s)) over () as v from s)"))
add("an_variance_min_effect", _engine(_single(_SIN, [_an([{"kind": "variance", "variance": 0.01, "min_effect_delta": 2.0}])])),
    _floor(f"n as (select t, x, {sql_normal(_key, chr(39) + 'variance' + chr(39), '0', 't')} * 0.01::DOUBLE * greatest(stddev_pop(x) over (), 0.25::DOUBLE) as n from y), z as (select t, x + n * 2 / max(abs(n)) over () as v from n)"))
_back = "list_transform(range(60), lambda i: case when i = 0 or i = 59 then xs[i + 1] when i < 3 then (1 - f[i + 1]) * xs[i + 1] + f[i + 1] * xs[(i - c + 60) % 60 + 1] when i >= 57 then (1 - f[60 - i]) * xs[i + 1] + f[60 - i] * xs[(i - c + 60) % 60 + 1] else xs[(i - c + 60) % 60 + 1] end)"
add("an_shift_min_effect", _engine(_single(_SIN, [_an([{"kind": "pattern-shift", "shift_by": 1, "transition_window": 3, "min_effect_delta": 3.0}])])),
    _floor(f"""l as (select list(x order by t) as xs, list_transform(range(3), lambda j: 0.5::DOUBLE * (1 - cos({lit(math.pi)} * j / 2))) as f from y),
c as (select xs, c, {_back} as ys from l, (select unnest([-3, -2, -1, 1, 2, 3]) as c)),
e as (select *, list_max(list_transform(range(60), lambda i: abs(ys[i + 1] - xs[i + 1]))) as e from c), b as (select * from e order by e desc, c limit 1),
z as (select y.t, case when i = 0 or i = 59 then x else x + (ys[i + 1] - x) * 3.0::DOUBLE / e end as v from y, b)"""))  # fmt: skip

# --- positions ------------------------------------------------------------------------------------------------------


def _positions(anomalies, channel=None, name="q"):
    """The windows of one series (anomaly, start, end)."""

    def run(spark, sf_dir):
        engine = Engine(spark, _single(channel or _SIN, anomalies, name=name), seed=SEED)
        return spark.createDataFrame([(k, s, e) for _, _, k, _, s, e in engine.labels()], "anomaly int, start long, end long")

    return run


def _placed(rows: str, start: str) -> str:
    """Windows placed one after the other: of 50 draws the first that ends in the series and meets no earlier window. ``rows``: (k, third, len) values."""
    u = sql_uniform(str(SEED), "'q'", "'test'", "'position'", "a.k", "j")
    return f"""with recursive a(k, third, len) as (values {rows}),
r as (
  select -1 as k, []::struct(s bigint, e bigint)[] as taken
  union all
  select a.k, list_append(r.taken, list_filter(list_transform(range(50), lambda j: {{'s': cast({start.format(u=u)} as bigint), 'e': cast({start.format(u=u)} + a.len as bigint)}}),
           lambda w: w.e < {N} and len(list_filter(r.taken, lambda b: w.s <= b.e and b.s <= w.e)) = 0)[1])
  from r join a on a.k = r.k + 1),
w as (select taken from r order by k desc limit 1)
select cast(i as int) as anomaly, taken[i + 1].s as start, taken[i + 1].e as "end" from (select taken, unnest(range(len(taken))) as i from w)"""


_mean = lambda p, n: {"position": p, "length": n, "kinds": [{"kind": "mean", "offset": 1.0}]}
add("an_position_section", _positions([_mean("end", 30), _mean("beginning", 30), _mean("middle", 30)]), _placed("(0, 2, 30), (1, 0, 30), (2, 1, 30)", f"a.third * {N // 3} + floor({{u}} * {N // 3})"))
_faster = lambda p, n: {"position": p, "length": n, "kinds": [{"kind": "frequency", "frequency_factor": 2.0}]}
#: 100 periods of 20 samples, 33 in each third.
add("an_position_period", _positions([_faster("middle", 40), _faster("end", 40), _faster("beginning", 40)]), _placed("(0, 1, 40), (1, 2, 40), (2, 0, 40)", "20 * (a.third * 33 + floor({u} * 33))"))
add("an_position_retry", _positions([_mean("end", 150), _mean("end", 130), _mean("end", 120), _mean("end", 60), _mean("beginning", 300), _mean("beginning", 200)]),
    _placed("(0, 2, 150), (1, 2, 130), (2, 2, 120), (3, 2, 60), (4, 0, 300), (5, 0, 200)", f"a.third * {N // 3} + floor({{u}} * {N // 3})"))

# --- planners ---------------------------------------------------------------------------------------------------------


def _shares(who: str, total: str, minima: str) -> str:
    """Whole lengths of a total: the minima (a list), the rest by drawn weights and largest remainders."""
    u = sql_uniform(who, "'length'", "k")
    return f"""u as (select *, list_transform(range(len({minima})), lambda k: {u}) as u, {total} - list_sum({minima}) as spare from i),
x as (select *, list_transform(range(len(u)), lambda k: spare * u[k + 1] / list_sum(u)) as exact from u),
f as (select *, list_transform(range(len(u)), lambda k: {minima}[k + 1] + cast(floor(exact[k + 1]) as bigint)) as low,
        list_transform(list_sort(list_transform(range(len(u)), lambda k: {{'r': floor(exact[k + 1]) - exact[k + 1], 'k': k}})), lambda r: r.k) as rest from x),
lengths as (select *, list_transform(range(len(u)), lambda k: low[k + 1] + case when list_position(rest, k) <= {total} - list_sum(low) then 1 else 0 end) as lens from f)"""


def _slots(who: str, n: int, channels: int) -> str:
    """Lengths placed one after the other: of 2500 draws the first that is free for all channels; numbered by start, channel and length."""
    c, s = (sql_uniform(who, "'segment'", "r.k", f"'{x}'", "j") for x in ("channel", "start"))
    return f"""r as (
  select instance, lens, 0 as k, []::struct(c int, s bigint, e bigint)[] as taken from lengths
  union all
  select instance, lens, k + 1, list_append(taken, list_filter(list_transform(range(2500), lambda j: {{'c': cast(floor({c} * {channels}) as int), 's': cast(floor({s} * ({n} - lens[r.k + 1] + 1)) as bigint), 'e': cast(floor({s} * ({n} - lens[r.k + 1] + 1)) + lens[r.k + 1] as bigint)}}),
           lambda w: len(list_filter(taken, lambda b: w.s < b.e and b.s < w.e)) = 0)[1])
  from r where k < len(lens)),
w as (select instance, unnest(taken) as w from r where k = len(lens))
select instance, cast(row_number() over (partition by instance order by w.s, w.c, w.e - w.s) - 1 as int) as segment, w.c as channel, w.s as start, w.e as "end" from w"""


add("pl_uniform_segments", lambda s, d: pl.uniform_segments(s, [(f"i{k}", 0.08, 6) for k in range(8)], 1000, 3, SEED),
    f"""with recursive i as (select 'i' || range as instance, [5, 5, 5, 5, 5, 5] as minima from range(8)), {_shares(f"{SEED}, instance", '80', 'minima')}, {_slots(f"{SEED}, instance", 1000, 3)}""")
add("pl_trend_segments", lambda s, d: pl.trend_segments(s, [(f"i{k}", [2.0 + j for j in range(5)]) for k in range(4)], 1000, 0.3, 0.25, SEED),
    f"""with recursive i as (select 'i' || range as instance, list_transform(range(5), lambda j: cast(greatest(5, ceil(30 / (2.0::DOUBLE + j))) as bigint)) as minima from range(4)), {_shares(f"{SEED}, instance", '250', 'minima')}, {_slots(f"{SEED}, instance", 1000, 1)}""")
add("pl_period_segments", lambda s, d: pl.period_segments(s, [("x", 1000, 7.0), ("y", 600, 3.3)], 3, SEED),
    f"""with recursive c(instance, n, f) as (values ('x', 1000::BIGINT, 7.0::DOUBLE), ('y', 600::BIGINT, 3.3::DOUBLE)), b as (
  select distinct instance, cast(least(greatest(t, 0), n) as bigint) as t from (
    select instance, n, round_even(k * (100 * (n - 1) / (f * n)), 0) as t from c, (select range as k from range(2000)) where k <= floor(n / (100 * (n - 1) / (f * n))) union all select instance, n, n from c)),
l as (select instance, list(t order by t) as starts from b group by instance),
o as (select instance, starts, list_transform(list_sort(list_transform(range(len(starts) - 3), lambda k: {{'u': {sql_uniform(str(SEED), 'instance', "'period'", 'k')}, 'k': k}})), lambda x: x.k) as ks from l),
r as (
  select instance, starts, ks, []::bigint[] as taken from o
  union all
  select instance, starts, ks, list_append(taken, list_filter(ks, lambda k: len(list_filter(taken, lambda x: abs(k - x) < 3)) = 0)[1]) from r
  where len(taken) < 3 and len(list_filter(ks, lambda k: len(list_filter(taken, lambda x: abs(k - x) < 3)) = 0)) > 0),
w as (select instance, starts, unnest(list_sort(arg_max(taken, len(taken)))) as k from r group by instance, starts)
select instance, cast(row_number() over (partition by instance order by k) - 1 as int) as segment, 0::int as channel, starts[k + 1] as start, starts[k + 4] as "end" from w""")  # fmt: skip
add("pl_energy_segments", lambda s, d: pl.energy_segments(_ev(s, d).withColumn("instance", F.lit("events")), 30, 12, 0.6, SEED),
    f"""with recursive {_EV}, m as (select channel, t, sqrt(greatest(0, (sum(base * base) over w) / 30)) as rms, count(*) over w as c from e window w as (partition by channel order by t rows between current row and 29 following)),
q as (select quantile_cont(rms, 0.6) as cut from m where c = 30),
a as (select list({{'race': race, 'c': channel, 't': t}} order by race, channel, t) as able from (
  select channel, t, -ln({sql_uniform(str(SEED), "'race'", "'events'", 'channel', 't')}) / (1 + rms - cut) as race from m, q where c = 30 and rms >= cut)),
r as (
  select 0 as k, []::struct(race double, c int, t bigint)[] as taken
  union all
  select k + 1, list_append(taken, list_filter(able, lambda x: len(list_filter(taken, lambda y: abs(x.t - y.t) < 30)) = 0)[1]) from r, a where k < 12),
w as (select unnest(list_filter(taken, lambda x: x is not null)) as w from r where k = 12)
select 'events' as instance, cast(row_number() over (order by w.t, w.c) - 1 as int) as segment, w.c as channel, w.t as start, w.t + 30 as "end" from w""")  # fmt: skip
add("pl_adapt_factor", lambda s, d: s.createDataFrame([(k, pl.adapt_factor(0.5 + 0.05 * k, 0.1 * (k % 7), {"adaptive_strength": True, "min_effect_delta": 0.2, "amplitude_factor_deadzone": [0.8, 1.2], "amplitude_factor_bounds": [0.25, 2.0]}, k)) for k in range(30)], "k int, factor double").select("k", r6(F.col("factor")).alias("factor")),
    f"""with x as (select range as k, 0.5::DOUBLE + 0.05::DOUBLE * range as f, 0.1::DOUBLE * (range % 7) as rms from range(30)),
a as (select k, case when rms > 1e-12::DOUBLE and 0.2::DOUBLE / rms > abs(f - 1) then 1 + case when abs(f - 1) > 1e-12::DOUBLE then case when f < 1 then -1 else 1 end when k % 2 = 0 then -1 else 1 end * 0.2::DOUBLE / rms else f end as f from x),
z as (select k, case when f >= 0.8::DOUBLE and f <= 1.2::DOUBLE then case when f >= 1 then 1.2::DOUBLE else 0.8::DOUBLE end else f end as f from a)
select cast(k as int) as k, {q6('least(2.0::DOUBLE, greatest(0.25::DOUBLE, f))')} as factor from z""")  # fmt: skip

# --- data sets ------------------------------------------------------------------------------------------------------------

_SMALL = {"dataset": {"length": 600, "channels": 3, "splits": ["train", "val"], "instances_per_split": 2}, "variants": {"base_oscillations": ["sine", "square"], "anomaly_types": ["mean", "amplitude"]}, "anomaly_policy": {"density_range": [0.05, 0.06], "segment_count_range": [4, 6], "density_tolerance": 0.005}}
_seed = lambda *parts: "('0x' || substr(sha256(concat_ws('|', " + ", ".join(parts) + ")), 9, 8))::UBIGINT::BIGINT"
_INSTANCES = f"""v as (select b || '__' || a || '__p00' as variant, b as base, a as anomaly from (values ('sine'), ('square')) b(b), (values ('mean'), ('amplitude')) a(a)),
n as (select v.*, split, k, {_seed('42', 'variant', 'split', 'k')} as seed from v, (values ('train'), ('val')) s(split), range(2) r(k)),
d as (select *, variant || '/' || split || '/' || lpad(k::varchar, 3, '0') as instance, 0.05::DOUBLE + (0.06::DOUBLE - 0.05::DOUBLE) * {sql_uniform('seed', "'density'")} as density from n),
c as (select *, cast(round_even(density * 600, 0) as bigint) as points, 4 + cast(floor({sql_uniform('seed', "'count'")} * 3) as bigint) as wanted from d),
i as (select *, list_transform(range(greatest(1, least(wanted, points // 5))), lambda k: 5) as minima from c)"""
add("ds_summary", lambda s, d: _ints(Dataset(s, _SMALL).summary()),
    f"""with {_INSTANCES}, {_shares('seed', 'points', 'minima')}
select instance as series, variant, split, base, anomaly, {q6('density')} as target_density, {q6('points / 600.0::DOUBLE')} as achieved_density, cast(len(lens) as bigint) as segments, {q6('list_avg(lens)')} as length_mean,
  {q6('list_stddev_pop(lens)')} as length_std, list_min(lens) as length_min, list_max(lens) as length_max, {q6('list_median(lens)')} as length_median from lengths""")  # fmt: skip
_PHASED = {"dataset": {"length": 400, "channels": 2, "splits": ["train", "val"], "instances_per_split": 1}, "variants": {"base_oscillations": ["sine"], "anomaly_types": ["mean"], "base_oscillation_overrides": {"sine": {"frequency": 4.0, "amplitude": 1.5, "variance": 0.0, "phase": 0.5}}, "split_phase_shift": {"enabled": True, "values": {"train": 0.0, "val": 6.0}}}, "anomaly_policy": {"density_range": [0.05, 0.06], "segment_count_range": [2, 3], "density_tolerance": 0.005}}
add("var_split_phase", lambda s, d: Dataset(s, _PHASED).samples().select("series", "channel", "t", r6(F.col("clean")).alias("clean")),
    f"""select 'sine__mean__p00/' || split || '/000' as series, c.range::int as channel, g.range as t, {q6(f"1.5::DOUBLE * sin({sql_theta(400, 4, 'g.range')} + (0.5::DOUBLE + shift) - floor((0.5::DOUBLE + shift) / 6.283185307179586::DOUBLE) * 6.283185307179586::DOUBLE)")} as clean
from range(400) g, range(2) c, (values ('train', 0.0::DOUBLE), ('val', 6.0::DOUBLE)) s(split, shift)""")  # fmt: skip


def demo_series(spark, sf_dir):
    """The demonstration series: a sine with noise, a pattern in its middle and a stronger stretch at its end."""
    demo = {"timeseries": [{"name": "q", "length": 1000, "base-oscillations": [{"kind": "sine", "frequency": 4.0, "variance": 0.05}], "anomalies": [{"position": "middle", "length": 50, "kinds": [{"kind": "pattern", "sinusoid_k": 10.0}]}, {"position": "end", "length": 10, "kinds": [{"kind": "amplitude", "amplitude_factor": 1.5}]}]}]}
    return Engine(spark, demo, seed=SEED).samples().select("series", "split", "channel", "t", r6(F.col("value")).alias("value"), "is_anomaly")


_place0, _place1 = (sql_uniform(str(SEED), "'q'", "'test'", "'position'", str(k), "j") for k in (0, 1))
add("demo_series", demo_series,
    f"""with a as (select list_transform(range(50), lambda j: 25 * (13 + cast(floor({_place0} * 13) as bigint)))[1] as s), b as (select s, list_filter(list_transform(range(50), lambda j: 666 + cast(floor({_place1} * 333) as bigint)), lambda x: x + 10 < 1000 and not (x <= s + 50 and s <= x + 10))[1] as z from a),
g as (select range as t, sin({sql_theta(1000, 4, 'range')}) as x, 0.05::DOUBLE * {sql_normal(_key, "'noise'", '0', 'range')} as n from range(1000)),
p as (select t, avg(x) over () + (max(x) over () - min(x) over ()) / 2 * atan(10 * (-1 + 2.0::DOUBLE * (t - s) / 49)) / {lit(math.atan(10))} as v from g, b where t >= s and t < s + 50)
select 'q' as series, 'test' as split, 0 as channel, g.t, {q6('coalesce(p.v, case when g.t > z and g.t < z + 9 then x * 1.5::DOUBLE else x end) + n')} as value, case when g.t >= s and g.t < s + 50 or g.t >= z and g.t < z + 10 then 1 else 0 end as is_anomaly
from g cross join b left join p on p.t = g.t""")  # fmt: skip

# --- scenarios: channels that hang together ----------------------------------------------------------------------------------


def sum_cancels_out(spark, sf_dir):
    """Two channels whose sum is zero but for the anomaly in one of them."""
    channels = [{"kind": "sine", "frequency": 5}, {"kind": "sine", "frequency": 5, "amplitude": -1.0}]
    rows = Engine(spark, _single(channels, [_an([{"kind": "platform", "value": 0.25}], channel=1)]), seed=SEED).samples()
    return rows.groupBy("t").agg(r6(F.sum("value")).alias("total"), F.max("is_anomaly").alias("is_anomaly"))


add("scenario_sum_cancels", sum_cancels_out, f"select t, {q6(f'case when t >= 300 and t < 360 then sin({_th}) + 0.25::DOUBLE else 0.0::DOUBLE end')} as total, case when t >= 300 and t < 360 then 1 else 0 end as is_anomaly from (select range as t from range({N}))")


def third_is_sum(spark, sf_dir):
    """Three channels, the third the sum of the others by formula; a mean shift in the first does not reach it."""
    channels = [{"kind": "sine", "frequency": 5}, {"kind": "cosine", "frequency": 2}, {"kind": "formula", "formula": {"base": 0, "operation": {"kind": "+", "operand": {"base": 1}}}}]
    rows = Engine(spark, _single(channels, [_an([{"kind": "mean", "offset": 0.5}])]), seed=SEED).samples()
    gap = F.sum(F.when(F.col("channel") == 2, F.col("value")).otherwise(-F.col("value")))
    return rows.groupBy("t").agg(r6(gap).alias("gap"))


add("scenario_third_is_sum", third_is_sum, f"select range as t, {q6('case when range >= 300 and range < 360 then -0.5::DOUBLE else 0.0::DOUBLE end')} as gap from range({N})")


def missing_pattern(spark, sf_dir):
    """A heart beat that falls silent for one stretch."""
    rows = Engine(spark, _single({"kind": "ecg", "frequency": 3, "amplitude": 2}, [_an([{"kind": "platform", "value": 0.0}])]), seed=SEED).samples()
    return rows.where("is_anomaly = 1").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), r6(F.max(F.abs("value"))).alias("peak"))


add("scenario_missing_pattern", missing_pattern, "select 0 as channel, 60::BIGINT as n, 0.0::DOUBLE as peak")

# --- the events table as custom inputs -----------------------------------------------------------------------------------------


def an_custom_events(spark, sf_dir):
    """The events table as one series for each event type, in its whole length: a mean shift in the middle of the first and a platform in the fourth."""
    rows = tables.event_channels(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumnRenamed("channel", "key")
    sizes = sorted(tuple(r) for r in rows.groupBy("key").agg(F.count(F.lit(1))).collect())  # one row for each event type
    extra = {0: lambda n: [_an([{"kind": "mean", "offset": 10.0}], length=n // 10, start=n // 2)], 3: lambda n: [_an([{"kind": "platform", "value": 7.0}], length=50, start=100)]}
    series = [{"name": str(c), "length": n, "base-oscillations": [{"kind": "custom-input", "input": "events", "key": c}], "anomalies": extra.get(c, lambda n: [])(n)} for c, n in sizes]
    out = Engine(spark, {"timeseries": series}, seed=SEED, inputs={"events": rows}).samples()
    return out.select(F.col("series").cast("int").alias("channel"), "t", r6(F.col("value")).alias("value"), "is_anomaly")


add("an_custom_events", an_custom_events, f"""with {_EV}, n as (select channel, count(*) as n from e group by channel)
select channel, t, {q6("case when channel = 0 and t >= n // 2 and t < n // 2 + n // 10 then base + 10 when channel = 3 and t >= 100 and t < 150 then 7.0::DOUBLE else base end")} as value,
  case when channel = 0 and t >= n // 2 and t < n // 2 + n // 10 or channel = 3 and t >= 100 and t < 150 then 1 else 0 end as is_anomaly from e join n using (channel)""")

__all__ = ["_K", "rng"]
