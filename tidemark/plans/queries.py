"""The registered queries of the time-series engine, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formula as fx
from ..functions import rng
from ..operators import labels as lb
from ..operators import planner as pl
from ..operators import stats as st
from ..operators import windows as win
from ..sources import config as cfg
from ..sources import tables
from .engine import Engine

QUERIES: dict = {}
SQL: dict = {}
SEED = 42
N = 2000


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def q6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


def lit(x) -> str:
    return f"{float(x)!r}::DOUBLE"


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def sql_uniform(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def sql_normal(*parts: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({sql_uniform(*parts, chr(39) + 'a' + chr(39))})) * cos({lit(2 * math.pi)} * {sql_uniform(*parts, chr(39) + 'b' + chr(39))}))"


def sql_theta(n: int, f: float, t: str = "t") -> str:
    return f"({lit(2 * math.pi)} * {lit(f)} * ({lit(n)} / 100.0::DOUBLE * {t} / {lit(n - 1)}))"


def sql_wrap(x: str) -> str:
    return f"({x} - floor({x} / {lit(2 * math.pi)}) * {lit(2 * math.pi)})"


def _single(channel: dict, anomalies=(), n: int = N, name: str = "q"):
    return {"timeseries": [{"name": name, "length": n, "base-oscillations": [channel] if isinstance(channel, dict) else list(channel), "anomalies": list(anomalies)}]}


def _engine(config, inputs=None):
    """A query over generated samples; ``inputs`` makes custom inputs from (spark, sf_dir)."""

    def run(spark, sf_dir):
        out = Engine(spark, config, seed=SEED, inputs=inputs(spark, sf_dir) if inputs else None).samples()
        return out.select("channel", "t", r6(F.col("value")).alias("value"), "is_anomaly")

    return run


def _gen(expr: str, n: int = N, label: str = "0", channel: int = 0) -> str:
    return f"select {channel} as channel, t, {q6(expr)} as value, {label} as is_anomaly from (select range as t from range({n}))"


# --- oscillators ----------------------------------------------------------------------------

_th = sql_theta(N, 5)
add("bo_sine", _engine(_single({"kind": "sine", "frequency": 5, "amplitude": 1.5})), _gen(f"sin({_th}) * 1.5::DOUBLE"))
add("bo_cosine", _engine(_single({"kind": "cosine", "frequency": 5})), _gen(f"cos({_th})"))
add("bo_square", _engine(_single({"kind": "square", "frequency": 0.7, "duty": 0.25})), _gen(f"case when {sql_wrap(sql_theta(N, 0.7))} < {lit(2 * math.pi * 0.25)} then 1.0::DOUBLE else -1.0::DOUBLE end"))
_m = sql_wrap(sql_theta(N, 1.3))
add("bo_sawtooth", _engine(_single({"kind": "sawtooth", "frequency": 1.3, "width": 0.75})),
    _gen(f"case when {_m} < {lit(2 * math.pi * 0.75)} then {_m} / {lit(math.pi * 0.75)} - 1 else ({lit(math.pi * 1.75)} - {_m}) / {lit(math.pi * 0.25)} end"))
_d = sql_theta(N, 2)
add("bo_dirichlet", _engine(_single({"kind": "dirichlet", "frequency": 2, "periodicity": 6})),
    _gen(f"case when abs(sin({_d} / 2)) < 1e-9::DOUBLE then case when cast(round({_d} / {lit(2 * math.pi)}) * 5 as bigint) % 2 = 0 then 1.0::DOUBLE else -1.0::DOUBLE end else sin(6 * {_d} / 2) / (6 * sin({_d} / 2)) end"))
add("bo_polynomial", _engine(_single({"kind": "polynomial", "polynomial": [0.5, -0.25, 0.001]})), _gen("0.5::DOUBLE - 0.25::DOUBLE * t + 0.001::DOUBLE * t * t"))
add("bo_freq_mod", _engine(_single({"kind": "sine", "frequency": 5, "freq-mod": 0.1})), _gen(f"sin({_th}) * sin({_th} * 0.1::DOUBLE)"))
_phi = f"({lit(2 * math.pi * 3)} * t / {lit(N)})"
add("bo_ecg_fallback", _engine(_single({"kind": "ecg", "frequency": 3, "amplitude": 2})),
    f"with x as (select range as t, 0.1::DOUBLE * sin(p) + pow(greatest(0.0::DOUBLE, sin(2 * p)), 6) + 0.2::DOUBLE * sin(p + {lit(math.pi / 4)}) as v from (select range, {lit(2 * math.pi * 3)} * range / {lit(N)} as p from range({N}))) select 0 as channel, t, {q6('(v - avg(v) over ()) * 2')} as value, 0 as is_anomaly from x")
_key = f"'{SEED}|q|test'"
_rw_n, _rw_taps = 1000, 10
_w = win.kernel(_rw_taps)
_fir = " + ".join(f"lead(walk, {j}) over (order by t) * {lit(_w[_rw_taps - 1 - j])}" for j in range(_rw_taps))
_u = sql_uniform(_key, "'walk'", "0", "0", "t")
_RW = f"""with s as (select range as t, {sql_uniform(_key, "'walk'", '0', '0', 'range')} as u from range({_rw_n + _rw_taps - 1})),
w as (select t, sum(case when t = 0 then 0.0::DOUBLE when u < {lit(1 / 3)} then -1.0::DOUBLE when u < {lit(2 / 3)} then 0.0::DOUBLE else 1.0::DOUBLE end) over (order by t) as walk from s),
f as (select t, {_fir} as x from w),
g as (select t, (x - min(x) over ()) / (max(x) over () - min(x) over ()) * 4 - 2 as base from f where t < {_rw_n})"""
add("bo_random_walk", _engine(_single({"kind": "random-walk", "amplitude": 2}, n=_rw_n)), f"{_RW} select 0 as channel, t, {q6('base')} as value, 0 as is_anomaly from g")
_mode = sql_uniform(_key, "'jump'", "92", f"t // {N // 50}")
add("bo_rmj", _engine(_single([{"kind": "random-mode-jump", "frequency": 50, "channel-diff": 0.5, "channel-offset": 1, "random-seed": 92}] * 2)),
    f"select c.range::int as channel, t, {q6(f'case when {_mode} < 0.5::DOUBLE then -1.0::DOUBLE else 1.0::DOUBLE end * (1 + 0.5::DOUBLE * c.range)')} as value, 0 as is_anomaly from (select range as t from range({N})), range(2) c")
_cp = lambda what: (_key, "'cbf'", "0", "0", f"'{what}'", "k")
add("bo_cbf", _engine(_single({"kind": "cylinder-bell-funnel", "avg-pattern-length": 20, "variance-pattern-length": 3, "variance-amplitude": 0.5, "amplitude": 2})),
    f"""with p as (select range as k, cast(floor({sql_uniform(*[x.replace('k', 'range') if x == 'k' else x for x in _cp('gap')])} * 20) as bigint) as gap from range({N})),
l as (select k, gap, greatest(1, cast(ceil(20 + 3 * {sql_normal(*_cp('length'))}) as bigint)) as len from p),
s as (select *, coalesce(sum(gap + len) over (order by k rows between unbounded preceding and 1 preceding), 0) + gap as start from l),
ok as (select *, max(case when start + len >= {N} then 1 else 0 end) over (order by k rows unbounded preceding) as bad from s),
h as (select *, floor({sql_uniform(*_cp('shape'))} * 3) as shape, (2 + 0.5::DOUBLE * {sql_normal(*_cp('height'))}) * case when {sql_uniform(*_cp('sign'))} > 0.5::DOUBLE then -1 else 1 end as height from ok where bad = 0)
select 0 as channel, t, {q6('coalesce(case when shape = 0 then height * (t - start) / len when shape = 1 then height * (len - 1 - (t - start)) / len else height end, 0.0::DOUBLE)')} as value, 0 as is_anomaly
from (select range as t from range({N})) g left join h on g.t >= h.start and g.t < h.start + h.len""")  # fmt: skip


_EV = "e as (select (dense_rank() over (order by event_type) - 1)::INTEGER as channel, row_number() over (partition by event_type order by ts, event_id) - 1 as t, value as base from events)"
_BIG = 10**7
add("bo_custom_events", lambda s, d: tables.event_channels(s.read.parquet(f"{d}/events.parquet")).select("channel", "t", r6(F.col("value")).alias("value")), f"with {_EV} select channel, t, {q6('base')} as value from e")

# --- variations -------------------------------------------------------------------------------

add("var_noise", _engine(_single({"kind": "sine", "frequency": 5, "amplitude": 2, "variance": 0.1})), _gen(f"sin({_th}) * 2 + 0.2::DOUBLE * {sql_normal(_key, chr(39) + 'noise' + chr(39), '0', 't')}"))
add("var_trend_nested", _engine(_single({"kind": "sine", "frequency": 5, "trend": {"kind": "polynomial", "polynomial": [0, 0.01], "trend": {"kind": "cosine", "frequency": 0.5}}})),
    _gen(f"sin({_th}) + 0.01::DOUBLE * t + cos({sql_theta(N, 0.5)})"))
add("var_offset", _engine(_single({"kind": "sine", "frequency": 5, "offset": 3})), _gen(f"sin({_th}) + 3"))
add("var_phase_shift", _engine(_single({"kind": "sine", "frequency": 5, "phase": 1.25})), _gen(f"sin({_th} + 1.25::DOUBLE)"))


def var_shared_noise(spark, sf_dir):
    from ..operators import series

    rows = Engine(spark, _single([{"kind": "sine", "variance": 0.2}, {"kind": "cosine", "variance": 0.3}]), seed=SEED).clean()
    return series.shared_noise(rows, 0.6, SEED).select("channel", "t", r6(F.col("noise")).alias("noise"))


add("var_shared_noise", var_shared_noise, f"""with x as (select c as channel, t, {sql_normal(_key, "'noise'", 'c', 't')} * case when c = 0 then 0.2::DOUBLE else 0.3::DOUBLE end as n, {sql_normal(str(SEED), "'shared'", "'q'", "'test'", 't')} as z
  from (select range as t from range({N})), (select range::INTEGER as c from range(2)))
select channel, t, {q6("0.8::DOUBLE * (n - avg(n) over p) + 0.6::DOUBLE * (z - avg(z) over p) / stddev_pop(z) over p * stddev_pop(n) over p + avg(n) over p")} as noise from x window p as (partition by channel)""")

# --- anomalies ----------------------------------------------------------------------------------


def _an(kinds, length=60, start=300, creeping=0, channel=0):
    return {"exact-position": start, "length": length, "channel": channel, "creeping-length": creeping, "kinds": kinds}


def _inside(base: str, inside: str, s: int, e: int, n: int = N, pre: str = "") -> str:
    """SQL for one window on a generated base: ``inside`` may use x, i and aggregates over window w."""
    return f"""with {pre} g as (select range as t, {base.replace('t)', 't)')} as x from (select range, range as t from range({n}))),
y as (select t, t - {s} as i, x from g where t >= {s} and t < {e}),
z as (select t, {inside} as v from y window w as (order by t rows between unbounded preceding and unbounded following))
select 0 as channel, g.t, {q6('coalesce(z.v, g.x)')} as value, case when g.t >= {s} and g.t < {e} then 1 else 0 end as is_anomaly from g left join z on g.t = z.t"""


_SIN = {"kind": "sine", "frequency": 5}
_hb = lambda z: f"exp(-pow({z} / 1.05::DOUBLE, 2) / 2)"
_low = _hb("(-3.0::DOUBLE)")
_bell = f"(case when i < 12 then {_hb('(-3 + 3.0::DOUBLE * i / 11)')} when i >= 48 then {_hb('(3.0::DOUBLE * (i - 48) / 11)')} else 1.0::DOUBLE end)"
add("an_amplitude", _engine(_single(_SIN, [_an([{"kind": "amplitude", "amplitude_factor": 2.0}])])), _inside(f"sin({_th})", f"x * (1 + ({_bell} - {_low}) / (1 - {_low}))", 300, 360))
add("an_amplitude_direct", _engine(_single(_SIN, [_an([{"kind": "amplitude", "amplitude_factor": 0.25, "transition_length": 0}])])), _inside(f"sin({_th})", "x * 0.25::DOUBLE", 300, 360))
_slow = f"(case when i < 20 then i / 19.0::DOUBLE when i < 52 then 1.0::DOUBLE else {_hb('(3.0::DOUBLE * (i - 52) / 7)')} end)"
add("an_amplitude_creep", _engine(_single(_SIN, [_an([{"kind": "amplitude", "amplitude_factor": 3.0}], creeping=20)])), _inside(f"sin({_th})", f"x * (1 + 2 * {_slow})", 300, 360))
_ux = sql_uniform
add("an_mean_creep", _engine(_single(_SIN, [_an([{"kind": "mean", "offset": 1.5}], creeping=20)])), _inside(f"sin({_th})", "x + 1.5::DOUBLE * case when i < 20 then i / 19.0::DOUBLE else 1.0::DOUBLE end", 300, 360))
_draw = rng.draw(SEED, "q", "test", "kind", 0)
add("an_extremum_global", _engine(_single({"kind": "sine", "frequency": 5, "variance": 0.01}, [_an([{"kind": "extremum", "min": True}], length=1)])),
    f"""with g as (select range as t, sin({sql_theta(N, 5, 'range')}) as x, 0.01::DOUBLE * {sql_normal(_key, "'noise'", '0', 'range')} as n from range({N})),
m as (select max(x) - min(x) as r, max(abs(n)) as mn from g), e as (select case when {lit(_draw + 0.5)} * r < 2 * mn then {lit(_draw + 0.5)} * r + 2 * mn else {lit(_draw + 0.5)} * r end as v from m)
select 0 as channel, t, {q6('x + n - case when t = 300 then (select v from e) else 0 end')} as value, case when t = 300 then 1 else 0 end as is_anomaly from g""")  # fmt: skip
add("an_extremum_local", _engine(_single({"kind": "sine", "frequency": 5}, [_an([{"kind": "extremum", "local": True, "context_window": 20}], length=1)])),
    f"""with g as (select range as t, sin({sql_theta(N, 5, 'range')}) as x from range({N})), e as (select {lit(_draw)} * (max(x) - min(x)) as v from g where t >= 290 and t < 311)
select 0 as channel, t, {q6('x + case when t = 300 then (select v from e) else 0 end')} as value, case when t = 300 then 1 else 0 end as is_anomaly from g""")  # fmt: skip
_ph = f"({sql_theta(N, 5, '300')} - {sql_theta(N, 10, '300')})"
_fast = f"sin({sql_theta(N, 10)} + {_ph})"
add("an_frequency", _engine(_single(_SIN, [_an([{"kind": "frequency", "frequency_factor": 2.0}])])),
    f"""with g as (select range as t, sin({sql_theta(N, 5, 'range')}) as x, sin({sql_theta(N, 10, 'range')} + {_ph}) as y from range({N})),
z as (select t, y + (1 - (t - 300) / 59.0::DOUBLE) * first_value(x - y) over w + (t - 300) / 59.0::DOUBLE * last_value(x - y) over w as v from g where t >= 300 and t < 360 window w as (order by t rows between unbounded preceding and unbounded following))
select 0 as channel, g.t, {q6('coalesce(z.v, g.x)')} as value, case when g.t >= 300 and g.t < 360 then 1 else 0 end as is_anomaly from g left join z on g.t = z.t""")  # fmt: skip
_tmpl = f"(atan(10 * (-1 + 2.0::DOUBLE * i / 59)) / {lit(math.atan(10))})"
add("an_pattern_sine", _engine(_single(_SIN, [_an([{"kind": "pattern", "sinusoid_k": 10, "blend_strength": 0.75}])])),
    _inside(f"sin({_th})", f"x + 0.75::DOUBLE * (avg(x) over w + (max(x) over w - min(x) over w) / 2 * {_tmpl} - x)", 300, 360))
_sq = f"case when {sql_wrap(sql_theta(N, 0.7))} < {lit(2 * math.pi * 0.25)} then 1.0::DOUBLE else -1.0::DOUBLE end"
add("an_pattern_square", _engine(_single({"kind": "square", "frequency": 0.7, "duty": 0.25}, [_an([{"kind": "pattern", "square_duty": 0.6}], length=200)])),
    f"""with g as (select range as t, {_sq.replace(' t ', ' range ')} as x, case when {sql_wrap(sql_theta(N, 0.7, 'range'))} < {lit(2 * math.pi * 0.6)} then 1.0::DOUBLE else -1.0::DOUBLE end as y from (select range, range as t from range({N})))
select 0 as channel, t, {q6('case when t >= 300 and t < 500 then y else x end')} as value, case when t >= 300 and t < 500 then 1 else 0 end as is_anomaly from g""")  # fmt: skip
add("an_pattern_sawtooth", _engine(_single({"kind": "sawtooth", "frequency": 1.3}, [_an([{"kind": "pattern", "sawtooth_width": 0.5}], length=200)])),
    f"""with g as (select range as t, {_m.replace(' t ', ' range ')} as m from (select range, range as t from range({N})))
select 0 as channel, t, {q6(f'case when t >= 300 and t < 500 then case when m < {lit(math.pi)} then m / {lit(math.pi * 0.5)} - 1 else ({lit(math.pi * 1.5)} - m) / {lit(math.pi * 0.5)} end else m / {lit(math.pi)} - 1 end')} as value, case when t >= 300 and t < 500 then 1 else 0 end as is_anomaly from g""")  # fmt: skip
for _mode, _fade in (("cosine", "0.5::DOUBLE * (1 - cos({pi} * {j} / 9))"), ("linear", "{j} / 9.0::DOUBLE")):
    _a = lambda j, f=_fade: f.format(pi=lit(math.pi), j=j)
    add(f"an_pattern_shift_{_mode[:6]}", _engine(_single(_SIN, [_an([{"kind": "pattern-shift", "shift_by": 5, "transition_window": 10, "crossfade_mode": _mode}])])),
        f"""with g as (select range as t, sin({sql_theta(N, 5, 'range')}) as x from range({N})), y as (select t, t - 300 as i, x from g where t >= 300 and t < 360),
r as (select a.t, a.i, a.x, b.x as s from y a join y b on b.i = (a.i - 5 + 60) % 60),
z as (select t, case when i = 0 or i = 59 then x when i < 10 then (1 - {_a('i')}) * x + {_a('i')} * s when i >= 50 then (1 - {_a('(59 - i)')}) * x + {_a('(59 - i)')} * s else s end as v from r)
select 0 as channel, g.t, {q6('coalesce(z.v, g.x)')} as value, case when g.t >= 300 and g.t < 360 then 1 else 0 end as is_anomaly from g left join z on g.t = z.t""")  # fmt: skip
add("an_platform", _engine(_single({"kind": "sine", "frequency": 5, "trend": {"kind": "polynomial", "polynomial": [0, 0.01]}}, [_an([{"kind": "platform", "value": 0.5}])])),
    f"select 0 as channel, t, {q6(f'case when t >= 300 and t < 360 then 0.5::DOUBLE else sin({_th}) + 0.01::DOUBLE * t end')} as value, case when t >= 300 and t < 360 then 1 else 0 end as is_anomaly from (select range as t from range({N}))")
add("an_platform_min_effect", _engine(_single(_SIN, [_an([{"kind": "platform", "value": 0.1, "min_effect_delta": 3.0}])])),
    _inside(f"sin({_th})", "0.1::DOUBLE + case when 0.1::DOUBLE - median(x) over w >= 0 then 1 else -1 end * (3 - greatest(abs(0.1::DOUBLE - min(x) over w), abs(0.1::DOUBLE - max(x) over w)))", 300, 360))
_lt = sql_theta(60, 3, "i")
add("an_trend_sine2", _engine(_single(_SIN, [_an([{"kind": "trend", "oscillation": {"kind": "sine", "frequency": 3, "amplitude": 2}}])])),
    _inside(f"sin({_th})", f"x + (2 * sin({_lt}) - (i / 59.0::DOUBLE) * 2 * sin({sql_theta(60, 3, '59')})) * pow(sin({lit(math.pi)} * i / 59), 2)", 300, 360))
_rise = f"(case when i < 12 then ({_hb('(-3 + 3.0::DOUBLE * i / 11)')} - {_low}) / (1 - {_low}) else 1.0::DOUBLE end)"
add("an_trend_legacy", _engine(_single(_SIN, [_an([{"kind": "trend", "oscillation": {"kind": "sine", "frequency": 3.3}, "boundary_mode": "legacy_carry_over"}])])),
    f"""select 0 as channel, t, {q6(f"x + case when t < 300 then 0 when t < 360 then sin({sql_theta(60, 3.3, 'i')}) * {_rise} else sin({sql_theta(60, 3.3, '59')}) end")} as value, case when t >= 300 and t < 360 then 1 else 0 end as is_anomaly
from (select range as t, range - 300 as i, sin({sql_theta(N, 5, 'range')}) as x from range({N}))""")  # fmt: skip
add("an_variance", _engine(_single({"kind": "sine", "frequency": 5, "variance": 0.02}, [_an([{"kind": "variance", "variance": 0.8}], creeping=20)])),
    f"""with g as (select range as t, sin({sql_theta(N, 5, 'range')}) as x, 0.02::DOUBLE * {sql_normal(_key, "'noise'", '0', 'range')} as n, {sql_normal(_key, "'variance'", '0', 'range')} as v from range({N})),
z as (select t, v * ((case when t < 320 then (t - 300) / 19.0::DOUBLE else 1.0::DOUBLE end) * (0.8::DOUBLE - 0.02::DOUBLE) + 0.02::DOUBLE) * greatest(stddev_pop(x) over (), 0.25::DOUBLE) as n from g where t >= 300 and t < 360)
select 0 as channel, g.t, {q6('g.x + coalesce(z.n, g.n)')} as value, case when g.t >= 300 and g.t < 360 then 1 else 0 end as is_anomaly from g left join z on g.t = z.t""")  # fmt: skip
_jump = f"case when {sql_uniform(_key, chr(39) + 'jump' + chr(39), '92', f't // {N // 50}')} < 0.5::DOUBLE then -1.0::DOUBLE else 1.0::DOUBLE end"
add("an_mode_correlation", _engine(_single({"kind": "random-mode-jump", "frequency": 50, "channel-offset": 1, "random-seed": 92}, [_an([{"kind": "mode-correlation"}])])),
    f"select 0 as channel, t, {q6(f'{_jump} * case when t >= 300 and t < 360 then -1 else 1 end')} as value, case when t >= 300 and t < 360 then 1 else 0 end as is_anomaly from (select range as t from range({N}))")
add("an_stacked_kinds", _engine(_single(_SIN, [_an([{"kind": "platform", "value": 0.5}, {"kind": "mean", "offset": 1.0}])])), _inside(f"sin({_th})", "0.5::DOUBLE + x + 1", 300, 360))
add("an_overlap_last_wins", _engine(_single(_SIN, [_an([{"kind": "mean", "offset": 1.0}]), _an([{"kind": "mean", "offset": -2.0}], start=330)])),
    f"select 0 as channel, t, {q6(f'sin({_th}) + case when t >= 330 and t < 390 then -2 when t >= 300 and t < 330 then 1 else 0 end')} as value, case when t >= 300 and t < 390 then 1 else 0 end as is_anomaly from (select range as t from range({N}))")


# --- formulas ---------------------------------------------------------------------------------------


def _formula(formula):
    return _engine(_single([{"kind": "sine", "frequency": 5}, {"kind": "cosine", "frequency": 2}, {"kind": "formula", "formula": formula}]))


def _fsql(expr: str) -> str:
    return f"""with g as (select range as t, sin({sql_theta(N, 5, 'range')}) as c0, cos({sql_theta(N, 2, 'range')}) as c1 from range({N})), h as (select t, c0, c1, {expr} as c2 from g)
select 0 as channel, t, {q6('c0')} as value, 0 as is_anomaly from h union all select 1, t, {q6('c1')}, 0 from h union all select 2, t, {q6('c2')}, 0 from h"""


_agg = lambda k: {"base": 1, "aggregation": {"kind": k}}
add("fx_arith", _formula({"base": {"base": 0, "operation": {"kind": "+", "operand": {"base": 1}}}, "operation": {"kind": "/", "operand": {"base": {"base": 0, "operation": {"kind": "-", "operand": 3}}}}}), _fsql("(c0 + c1) / (c0 - 3)"))
add("fx_power", _formula({"base": 0, "operation": {"kind": "**", "operand": 2}}), _fsql("pow(c0, 2)"))
for _k, _e in (("sum", "sum(c1) over ()"), ("min", "min(c1) over ()"), ("max", "max(c1) over ()"), ("median", "median(c1) over ()"), ("std", "stddev_pop(c1) over ()"), ("var", "var_pop(c1) over ()")):
    add(f"fx_agg_{_k}", _formula({"base": 0, "operation": {"kind": "*", "operand": _agg(_k)}}), _fsql(f"c0 * {_e}"))
add("formula_nested", _formula({"base": {"base": 0, "operation": {"kind": "+", "operand": {"base": 0}}}, "operation": {"kind": "*", "operand": {"base": 1, "aggregation": {"kind": "sum"}}}}), _fsql("(c0 + c0) * sum(c1) over ()"))

# --- windows, over the events table --------------------------------------------------------------------


def _ev(spark, sf_dir):
    return tables.event_channels(spark.read.parquet(f"{sf_dir}/events.parquet"))


_K = ["channel"]
add("win_rms", lambda s, d: win.sliding_rms(_ev(s, d), 25, _K).select("channel", "t", r6(F.col("rms")).alias("rms")),
    f"with {_EV}, f as (select channel, t, sqrt(avg(base * base) over w) as rms, count(*) over w as c from e window w as (partition by channel order by t rows between current row and 24 following)) select channel, t, {q6('rms')} as rms from f where c = 25")
add("win_peak", lambda s, d: win.sliding_peak(_ev(s, d), 25, _K).select("channel", "t", r6(F.col("peak")).alias("peak")),
    f"with {_EV}, f as (select channel, t, max(abs(base)) over w as peak, count(*) over w as c from e window w as (partition by channel order by t rows between current row and 24 following)) select channel, t, {q6('peak')} as peak from f where c = 25")
_w7 = win.kernel(7, 1.4)
add("win_fir", lambda s, d: _ev(s, d).withColumn("y", win.fir(F.col("value"), F.lit(_w7).cast("array<double>"), _K, 7)).where("y is not null").select("channel", "t", r6(F.col("y")).alias("y")),
    f"with {_EV}, f as (select channel, t, {' + '.join(f'lead(base, {j}) over w * {lit(_w7[6 - j])}' for j in range(7))} as y from e window w as (partition by channel order by t)) select channel, t, {q6('y')} as y from f where y is not null")
add("win_prefix", lambda s, d: _ev(s, d).select("channel", "t", F.round(win.prefix_sum(F.col("value"), _K), 4).alias("total")), f"with {_EV} select channel, t, round(sum(base) over (partition by channel order by t), 4) as total from e")
add("win_roll", lambda s, d: win.roll(_ev(s, d), 3, _K).select("channel", "t", r6(F.col("rolled")).alias("rolled")),
    f"with {_EV}, n as (select channel, count(*) as n from e group by channel) select a.channel, a.t, {q6('b.base')} as rolled from e a join n using (channel) join e b on a.channel = b.channel and b.t = (a.t - 3 + n) % n")
add("win_reverse", lambda s, d: win.reverse(_ev(s, d), _K).select("channel", "t", r6(F.col("reversed")).alias("reversed")),
    f"with {_EV}, n as (select channel, count(*) as n from e group by channel) select a.channel, a.t, {q6('b.base')} as reversed from e a join n using (channel) join e b on a.channel = b.channel and b.t = n - 1 - a.t")
add("win_lerp", lambda s, d: win.resample(_ev(s, d), 500, _K).select("channel", "t", r6(F.col("resampled")).alias("resampled")),
    f"""with {_EV}, n as (select channel, count(*) as n from e group by channel), g as (select channel, n, range as t, range * (n - 1) / 499.0::DOUBLE as p from n, range(500))
select g.channel, g.t, {q6('a.base + (p - floor(p)) * (b.base - a.base)')} as resampled from g join e a on a.channel = g.channel and a.t = cast(floor(p) as bigint) join e b on b.channel = g.channel and b.t = least(cast(floor(p) as bigint) + 1, n - 1)""")  # fmt: skip
add("win_free_slot", lambda s, d: win.free_slots(_ev(s, d).withColumn("busy", (F.col("value") > 100).cast("int")), 5, _K).select("channel", "t"),
    f"with {_EV}, f as (select channel, t, sum(case when base > 100 then 1 else 0 end) over w as b, count(*) over w as c from e window w as (partition by channel order by t rows between current row and 4 following)) select channel, t from f where b = 0 and c = 5")
add("win_context", lambda s, d: _ev(s, d).select("channel", "t", r6(win.context_range(F.col("value"), 10, _K)).alias("spread")),
    f"with {_EV} select channel, t, {q6('max(base) over w - min(base) over w')} as spread from e window w as (partition by channel order by t rows between 5 preceding and 5 following)")
add("win_minmax", lambda s, d: _ev(s, d).select("channel", "t", r6(win.min_max(F.col("value"), F.lit(-1.0), F.lit(1.0), _K)).alias("scaled")),
    f"with {_EV} select channel, t, {q6('(base - min(base) over w) / (max(base) over w - min(base) over w) * 2 - 1')} as scaled from e window w as (partition by channel)")

# --- labels ---------------------------------------------------------------------------------------------


def _orders_events(spark):
    return spark.createDataFrame([(0, 0, 10, 40), (0, 1, 35, 60), (1, 0, 5, 6), (2, 0, 100, 300), (3, 0, 0, 50)], "channel long, event long, start long, end long")


_EVENTS = "ev as (select channel, event::BIGINT as event, s::BIGINT as s, e::BIGINT as e from (values (0, 0, 10, 40), (0, 1, 35, 60), (1, 0, 5, 6), (2, 0, 100, 300), (3, 0, 0, 50)) v(channel, event, s, e))"
add("lb_points", lambda s, d: lb.point_labels(_ev(s, d).select("channel", "t"), _orders_events(s), _K, few=True).select("channel", "t", "label"),
    f"with {_EV}, {_EVENTS} select channel, t, case when exists (select 1 from ev where ev.channel = e.channel and t >= ev.s and t < ev.e) then 1 else 0 end as label from e")


def _before_after(spark, sf_dir):
    return _ev(spark, sf_dir).select("channel", "t", F.col("value").alias("before"), (F.col("value") + F.when(F.col("t") % 7 < 3, F.col("value") * F.col("value") / 1000.0).otherwise(0.0)).alias("after"))


_DELTA = "abs(base + (case when t % 7 < 3 then base * base / 1000.0::DOUBLE else 0 end) - base)"
_SUP = f"with {_EV}, {_EVENTS}, d as (select ev.*, t, {_DELTA} as delta from e join ev on ev.channel = e.channel and t >= ev.s and t < ev.e), m as (select *, max(delta) over (partition by channel, event) as peak from d), a as (select channel, event, any_value(s) as s, any_value(e) as e, coalesce(min(t) filter (delta > 0.3::DOUBLE * peak), any_value(s)) as a, coalesce(max(t) filter (delta > 0.3::DOUBLE * peak) + 1, any_value(e)) as b from m group by channel, event)"
add("lb_effective_support", lambda s, d: lb.effective_support(_before_after(s, d), _orders_events(s), _K, eps=0.3), f"{_SUP} select channel, event, a as start, b as \"end\", s as source_start, e as source_end from a")
add("lb_min_length", lambda s, d: lb.effective_support(_before_after(s, d), _orders_events(s), _K, eps=0.99, min_length=12),
    f"""{_SUP.replace('0.3::DOUBLE * peak', '0.99::DOUBLE * peak')}, c as (select channel, event, t, round(sum(delta) over w, 9) as score, count(*) over w as k, least(12, any_value(e - s) over (partition by channel, event)) as size from m window w as (partition by channel, event order by t rows between current row and 11 following)),
b1 as (select channel, event, t, row_number() over (partition by channel, event order by score desc, t) as r from c where k = size), f as (select a.*, least(12, e - s) as size, b1.t as w from a join b1 using (channel, event) where r = 1)
select channel, event, case when b - a < size then w else a end as start, case when b - a < size then w + size else b end as "end", s as source_start, e as source_end from f""")  # fmt: skip


def lb_consistency(spark, sf_dir):
    labels = lb.point_labels(_ev(spark, sf_dir).select("channel", "t"), _orders_events(spark), _K)
    wrong = labels.withColumn("label", F.when((F.col("channel") == 0) & (F.col("t") == 12), 0).otherwise(F.col("label")))
    return lb.mismatches(wrong.select("channel", "t", "label"), _orders_events(spark), _K).groupBy().agg(F.count(F.lit(1)).alias("mismatches"))


add("lb_consistency", lb_consistency,
    f"""with {_EV}, {_EVENTS}, l as (select channel, t, case when exists (select 1 from ev where ev.channel = e.channel and t >= ev.s and t < ev.e) then 1 else 0 end as expected from e)
select count(*) as mismatches from l where expected <> case when channel = 0 and t = 12 then 0 else expected end""")  # fmt: skip
add("lb_density", lambda s, d: lb.check_density(lb.density(lb.point_labels(_ev(s, d).select("channel", "t"), _orders_events(s), _K).withColumn("series", F.lit("events")), ["series"]), 0.05, 0.2, 0.01).select("series", r6(F.col("density")).alias("density"), F.col("ok").cast("int").alias("ok")),
    f"with {_EV}, {_EVENTS}, l as (select channel, t, case when exists (select 1 from ev where ev.channel = e.channel and t >= ev.s and t < ev.e) then 1 else 0 end as label from e), a as (select t, max(label) as any_ from l group by t), f as (select avg(any_) as d from a) select 'events' as series, {q6('d')} as density, case when d >= 0.04::DOUBLE and d <= 0.21::DOUBLE then 1 else 0 end as ok from f")

# --- statistics, over orders and lineitem as instances ---------------------------------------------------------


def _segments(spark, sf_dir):
    """Line items as segments: the order is the instance, the quantity the length."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return l.select(F.col("l_orderkey").alias("instance"), F.lit(0).cast("long").alias("start"), F.col("l_quantity").cast("long").alias("end"), F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("split"))


_SEG = "seg as (select l_orderkey as instance, cast(l_quantity as bigint) as l, l_returnflag as variant, l_linestatus as split from lineitem)"
_five = lambda c, p: f"{q6(f'avg({c})')} as {p}_mean, {q6(f'stddev_pop({c})')} as {p}_std, min({c}) as {p}_min, max({c}) as {p}_max"
_ints = lambda df: df.select(*[r6(F.col(c)).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns])
add("ag_instance", lambda s, d: _ints(st.instance_summary(_segments(s, d), ["instance"])), f"with {_SEG} select instance, count(*) as segments, {_five('l', 'length')}, {q6('median(l)')} as length_median from seg group by instance")
add("ag_split_stats", lambda s, d: _ints(st.split_statistics(_segments(s, d).groupBy("split", "variant", "instance").agg(F.count(F.lit(1)).alias("segments")), ["split"], ("segments",))),
    f"with {_SEG}, i as (select split, variant, instance, count(*) as segments from seg group by all) select split, count(*) as instances, {_five('segments', 'segments')} from i group by split")
add("ag_rollup", lambda s, d: _ints(st.rollup_statistics(_segments(s, d).groupBy("split", "variant", "instance").agg(F.count(F.lit(1)).alias("segments")))),
    f"with {_SEG}, i as (select split, variant, instance, count(*) as segments from seg group by all) select variant, split, count(*) as instances, {_five('segments', 'segments')}, {q6('median(segments)')} as segments_median from i group by rollup (variant, split)")
add("ag_metadata", lambda s, d: _ints(st.metadata(_ev(s, d).withColumn("series", F.lit("events")), _orders_events(s).withColumn("series", F.lit("events")), ["series"])),
    f"""with {_EV}, {_EVENTS}, a as (select t, stddev_pop(base) as sd, sum(base) as s, count(*) as c from e group by t)
select 'events' as series, count(*) as length, max(c) as dimensions, {q6('sum(s) / sum(c)')} as mean, {q6('avg(sd)')} as stddev, (select count(*) from ev) as num_anomalies, (select min(e - s) from ev)::BIGINT as min_anomaly_length,
{q6('(select median(e - s) from ev)')} as median_anomaly_length, (select max(e - s) from ev)::BIGINT as max_anomaly_length, {q6('(select sum(e - s) from ev) / count(*)')} as contamination from a""")  # fmt: skip
_CH = [("a", "sine", 4.0, 6.0, 7, 1000), ("a", "dirichlet", 5.0, 6.0, 7, 1000), ("b", "mls", 1.0, 6.0, 5, 1000), ("b", "random-mode-jump", 50.0, 6.0, 7, 1000), ("c", "random-walk", 1.0, 6.0, 7, 1000)]
add("ag_period_size", lambda s, d: _ints(st.period_sizes(s.createDataFrame(_CH, "series string, kind string, frequency double, periodicity double, complexity int, n long"), ["series"])),
    f"""with c(series, kind, f, periodicity, complexity, n) as (values {', '.join(f"('{a}', '{b}', {c}, {d}, {e}, {n})" for a, b, c, d, e, n in _CH)})
select series, median(case when kind in ('sine', 'cosine', 'ecg', 'square', 'sawtooth') then floor(100 / f) when kind = 'dirichlet' then floor(100 / f) * case when cast(periodicity as int) % 2 = 0 then 2 else 1 end
  when kind = 'mls' then pow(2, complexity) - 1 when kind = 'random-mode-jump' then floor(n / f) end::DOUBLE) as period_size from c group by series""")  # fmt: skip
add("ag_quantile", lambda s, d: st.quantiles(win.sliding_rms(_ev(s, d), 25, _K), "rms", 0.6, _K).select("channel", r6(F.col("threshold")).alias("threshold")),
    f"with {_EV}, f as (select channel, t, sqrt(avg(base * base) over w) as rms, count(*) over w as c from e window w as (partition by channel order by t rows between current row and 24 following)) select channel, {q6('quantile_cont(rms, 0.6)')} as threshold from f where c = 25 group by channel")
add("ag_dedupe", lambda s, d: st.distinct_first(s.read.parquet(f"{d}/events.parquet"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id"),
    "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1")
add("ag_corr", lambda s, d: st.pairwise_correlation(_ev(s, d).withColumn("series", F.lit("e")), ["series"]).select("a", "b", r6(F.col("corr")).alias("corr")),
    f"with {_EV} select x.channel as a, y.channel as b, {q6('corr(x.base, y.base)')} as corr from e x join e y on x.t = y.t and x.channel < y.channel group by all")
add("ag_daily_series", lambda s, d: tables.daily_sums(s.read.parquet(f"{d}/lineitem.parquet")).select("channel", "t", F.round("value", 2).alias("value")),
    "select l_returnflag as channel, date_diff('day', (select min(l_shipdate)::DATE from lineitem), l_shipdate::DATE) as t, round(sum(l_extendedprice), 2) as value from lineitem group by 1, 2")
add("ag_vector_rms", lambda s, d: win.sliding_rms(tables.vector_series(s.read.parquet(f"{d}/embeddings.parquet")), 16, ["series"]).groupBy("series").agg(r6(F.max("rms")).alias("rms")),
    f"with v as (select vec_id as series, unnest(embedding)::DOUBLE as x, generate_subscripts(embedding, 1) - 1 as t from embeddings), f as (select series, t, sqrt(avg(x * x) over w) as rms, count(*) over w as c from v window w as (partition by series order by t rows between current row and 15 following)) select series, {q6('max(rms)')} as rms from f where c = 16 group by series")

# --- planners -----------------------------------------------------------------------------------------------------

#: The oscillations and the anomalies allowed on them, by anomaly.
_PAIRS = """amplitude: sine cosine square sawtooth dirichlet random-walk cylinder-bell-funnel ecg mls custom-input
extremum: sine cosine square sawtooth dirichlet random-walk cylinder-bell-funnel ecg polynomial mls formula custom-input
mean: sine cosine square sawtooth dirichlet random-walk cylinder-bell-funnel ecg polynomial mls formula custom-input
platform: sine cosine square sawtooth dirichlet random-walk cylinder-bell-funnel ecg polynomial mls formula custom-input
trend: sine cosine square sawtooth dirichlet random-walk cylinder-bell-funnel ecg polynomial mls formula custom-input
variance: sine cosine square sawtooth dirichlet random-walk cylinder-bell-funnel ecg polynomial mls formula custom-input
frequency: sine cosine square sawtooth dirichlet ecg
pattern-shift: sine cosine square sawtooth dirichlet ecg
pattern: sine cosine square sawtooth dirichlet ecg cylinder-bell-funnel mls
mode-correlation: random-mode-jump"""
_GRID = f"""c as (select split_part(line, ': ', 1) as anomaly, unnest(string_split(split_part(line, ': ', 2), ' ')) as base from (select unnest(string_split('{_PAIRS}', chr(10))) as line)),
g as (select anomaly, base from (select distinct anomaly from c), (select distinct base from c))"""


def _grid(spark):
    a = spark.createDataFrame([(x,) for x in cfg.ANOMALIES], "anomaly string")
    return a.crossJoin(spark.createDataFrame([(x,) for x in cfg.KINDS], "base string"))


add("compat_semi", lambda s, d: _grid(s).join(cfg.compat_frame(s), ["anomaly", "base"], "left_semi"), f"with {_GRID} select g.* from g semi join c using (anomaly, base)")
add("compat_anti", lambda s, d: _grid(s).join(cfg.compat_frame(s), ["anomaly", "base"], "left_anti"), f"with {_GRID} select g.* from g anti join c using (anomaly, base)")
add("only_filter", lambda s, d: Engine(s, {"timeseries": [_single(_SIN, name=x)["timeseries"][0] for x in ("a", "b")]}, only="b").samples().groupBy("series").agg(F.count(F.lit(1)).alias("n")), f"select s as series, count(*) as n from (values ('a'), ('b')) x(s), range({N}) where s = 'b' group by s")
add("pl_variants", lambda s, d: pl.variants(s, profiles=2, disabled=("extremum",), skip_bases=("custom-input", "formula")),
    f"""with {_GRID}, p as (select * from (values ('p00'), ('p01')) p(profile)) select g.base || '__' || g.anomaly || '__' || profile as variant_id, g.base || '__' || g.anomaly as pair_id, g.base, g.anomaly, profile,
case when g.base in ('custom-input', 'formula') then 'base skipped' when g.anomaly = 'extremum' then 'anomaly disabled' when c.base is null then 'incompatible' end as reason from g cross join p left join c on c.anomaly = g.anomaly and c.base = g.base""")  # fmt: skip
add("pl_seed", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", rng.seed_column(F.lit(SEED), "plan", F.col("o_orderkey")).alias("seed")),
    f"select o_orderkey, ('0x' || substr(sha256(concat_ws('|', {SEED}, 'plan', o_orderkey)), 9, 8))::UBIGINT::BIGINT as seed from orders")
_pk = lambda what: sql_uniform(str(SEED), f"'{what}'", "o_orderkey")
add("pl_distributions", lambda s, d: pl.realise(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), {"a": {"min": 1.0, "max": 3.0}, "b": {"distribution": "int_uniform", "low": 2, "high": 5}, "c": {"distribution": "choice", "values": [1.0, 2.5, 7.0]}, "d": {"distribution": "bernoulli", "p": 0.3}, "e": 4.0}, [F.lit(SEED)], ["o_orderkey"]).select("o_orderkey", *[r6(F.col(c)).alias(c) for c in "abcde"]),
    f"select o_orderkey, {q6('1 + 2 * ' + _pk('a'))} as a, floor(2 + {_pk('b')} * 4) + 0.0::DOUBLE as b, case floor({_pk('c')} * 3) when 0 then 1.0::DOUBLE when 1 then 2.5::DOUBLE else 7.0::DOUBLE end as c, case when {_pk('d')} < 0.3::DOUBLE then 1.0::DOUBLE else 0.0::DOUBLE end as d, 4.0::DOUBLE as e from orders")
add("pl_point_events", lambda s, d: pl.point_events(s, [("a", 0.05), ("b", 0.031)], 2000, 3, SEED),
    f"""with i(instance, density) as (values ('a', 0.05::DOUBLE), ('b', 0.031::DOUBLE)), g as (select instance, density, range as t, {sql_uniform(str(SEED), "'point'", 'instance', 'range')} as u from i, range(2000)),
r as (select *, row_number() over (partition by instance order by u, t) as k from g) select instance, t, cast(floor({sql_uniform(str(SEED), "'channel'", 'instance', 't')} * 3) as int) as channel from r where k <= floor(density * 2000)""")  # fmt: skip
add("pl_period_boundaries", lambda s, d: pl.period_boundaries(s, [("x", 1000, 7.0), ("y", 600, 3.3)]),
    """with c(series, n, f) as (values ('x', 1000::BIGINT, 7.0::DOUBLE), ('y', 600::BIGINT, 3.3::DOUBLE)), s as (select *, 100 * (n - 1) / (f * n) as size from c),
b as (select series, n, round_even(k * size, 0) as t from s, (select range as k from range(2000)) where k <= floor(n / size) and size > 1 union all select series, n, n from s) select distinct series, cast(least(greatest(t, 0), n) as bigint) as t from b""")  # fmt: skip
add("pl_freq_ratio", lambda s, d: pl.frequency_ratios(s, [2, 3, 4], [-1, 1], 0.6, 1.4).select("k", "offset", r6(F.col("ratio")).alias("ratio")),
    f"select k, o as \"offset\", {q6('(k + o) / k::DOUBLE')} as ratio from (values (2), (3), (4)) a(k), (values (-1), (1)) b(o) where (k + o) / k::DOUBLE between 0.6::DOUBLE and 1.4::DOUBLE")
add("pl_amp_adapt", lambda s, d: pl.adapt_amplitude(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (1 + F.col("l_discount") - F.col("l_tax")).alias("factor"), (F.col("l_quantity") / 50).alias("rms")), 0.2, 0.25, 2.0, 0.1).select("l_orderkey", "l_linenumber", r6(F.col("adapted")).alias("adapted")),
    f"""with x as (select l_orderkey, l_linenumber, 1 + l_discount - l_tax as f, l_quantity / 50 as r from lineitem), y as (select *, case when f - 1 >= 0 then 1 else -1 end as sg, greatest(abs(f - 1), 0.2::DOUBLE / greatest(r, 1e-9::DOUBLE), 0.1::DOUBLE) as m from x)
select l_orderkey, l_linenumber, {q6('least(2.0::DOUBLE, greatest(0.25::DOUBLE, 1 + sg * m))')} as adapted from y""")  # fmt: skip
add("pl_normalise_length", lambda s, d: pl.normalise_length(_ev(s, d), 80, _K, "crop").select("channel", "t", r6(F.col("value")).alias("value")), f"with {_EV} select channel, t, {q6('base')} as value from e where t < 80")
add("pl_normalise_pad", lambda s, d: pl.normalise_length(_ev(s, d).where("t < 100"), 120, _K, "pad").select("channel", "t", r6(F.col("value")).alias("value")),
    f"with {_EV}, c as (select distinct channel from e) select c.channel, g.range as t, {q6('e.base')} as value from c, range(120) g join e on e.t = least(g.range, 99) and e.channel = c.channel")


def pl_normalise_pad_whole(spark, sf_dir):
    """Whole channels, padded to 20 rows more than the longest has."""
    ev = _ev(spark, sf_dir)
    longest = ev.agg(F.max("t")).first()[0] + 1
    return pl.normalise_length(ev, longest + 20, _K, "pad").select("channel", "t", r6(F.col("value")).alias("value"))


add("pl_normalise_pad_whole", pl_normalise_pad_whole,
    f"""with {_EV}, c as (select channel, max(t) as l from e group by channel), g as (select unnest(range((select max(l) + 21 from c))) as t)
select c.channel, g.t, {q6('e.base')} as value from c, g join e on e.t = least(g.t, c.l) and e.channel = c.channel""")  # fmt: skip
add("zoom_topk", lambda s, d: s.read.parquet(f"{d}/events.parquet").withColumn("u", rng.uniform(F.lit(SEED), "zoom", F.col("event_id"))).orderBy("u", "event_id").limit(5).select("event_id"),
    f"select event_id from events order by {sql_uniform(str(SEED), chr(39) + 'zoom' + chr(39), 'event_id')}, event_id limit 5")


def queries():
    from . import queries_more  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql():
    queries()
    return dict(SQL)


__all__ = ["Window", "fx", "oracle_sql", "queries"]
