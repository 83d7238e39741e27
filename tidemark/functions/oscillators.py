"""Closed-form oscillations as column expressions of the time index and parameter columns.

Parameters may be columns or plain numbers, so one expression serves a table of many
channels as well as a single one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2.0 * math.pi
#: Kinds that are functions of t alone.
CLOSED = ("sine", "cosine", "square", "sawtooth", "dirichlet", "polynomial", "random-mode-jump")
CARRIERS = ("sine", "cosine", "square", "sawtooth")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def theta(t: Column, n, frequency) -> Column:
    """Angle at sample t of n: a grid of n points from 0 to n / 100, both ends included."""
    n = _c(n)
    grid = F.when(n > 1, n / 100.0 * t / F.greatest(n - 1.0, F.lit(1.0))).otherwise(0.0)
    return TAU * _c(frequency) * grid


def wrap(x: Column) -> Column:
    """x modulo 2 pi, in [0, 2 pi)."""
    return x - F.floor(x / TAU) * TAU


def square_wave(x: Column, duty) -> Column:
    return F.when(wrap(x) < TAU * _c(duty), 1.0).otherwise(-1.0)


def sawtooth_wave(x: Column, width) -> Column:
    w, m = _c(width), wrap(x)
    up = F.when(w > 0, m / F.when(w > 0, math.pi * w) - 1.0)
    down = (math.pi * (w + 1.0) - m) / F.when(w < 1, math.pi * (1.0 - w))
    return F.when(m < TAU * w, up).otherwise(F.coalesce(down, F.lit(1.0)))


def dirichlet_kernel(x: Column, periodicity) -> Column:
    """sin(N x / 2) / (N sin(x / 2)), with its limit at multiples of 2 pi."""
    n, half = _c(periodicity), F.sin(x / 2.0)
    k = F.rint(x / TAU) * (n - 1.0)
    limit = F.when(F.abs(k) % 2.0 == 0, 1.0).otherwise(-1.0)
    return F.when(F.abs(half) < 1e-9, limit).otherwise(F.sin(n * x / 2.0) / (n * F.when(F.abs(half) >= 1e-9, half)))


def _wave(kind: str, x: Column, p) -> Column:
    if kind == "sine":
        return F.sin(x)
    if kind == "cosine":
        return F.cos(x)
    if kind == "square":
        return square_wave(x, p["duty"])
    return sawtooth_wave(x, p["width"])


def carrier(kind: str, t: Column, p, frequency=None, phase=None, duty=None, width=None) -> Column:
    """a f(theta + phase), times f((theta + phase) m) if the modulation m is not zero."""
    own = {"duty": p["duty"] if duty is None else duty, "width": p["width"] if width is None else width}
    x = theta(t, p["n"], p["frequency"] if frequency is None else frequency) + _c(p["phase"] if phase is None else phase)
    y = _wave(kind, x, own) * _c(p["amplitude"])
    return F.when(_c(p["freq_mod"]) == 0, y).otherwise(y * _wave(kind, x * _c(p["freq_mod"]), own))


def ecg_wave(t: Column, n, frequency) -> Column:
    """The heart-beat shape before centring and scaling; the end of the angle grid is excluded."""
    phi = TAU * _c(frequency) * t / _c(n)
    return 0.1 * F.sin(phi) + F.pow(F.greatest(F.lit(0.0), F.sin(2.0 * phi)), F.lit(6.0)) + 0.2 * F.sin(phi + math.pi / 4)


def polynomial(t: Column, coefficients) -> Column:
    """Sum of c_i t**i, by Horner's rule; ``coefficients`` is an array column or a list."""
    if isinstance(coefficients, Column):
        return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * t + c)
    out = F.lit(0.0)
    for c in reversed(list(coefficients)):
        out = out * t + float(c)
    return out


def closed_form(t: Column, p, frequency=None, phase=None, duty=None, width=None, kinds=CLOSED) -> Column:
    """The oscillation of the kind in ``p["kind"]`` (null for kinds that are no function of t alone).

    ``p`` maps parameter names to columns; overrides replace frequency, phase, duty or width.
    ``kinds``: those that can occur, which keeps the expression short.
    """
    from .rng import uniform

    f = p["frequency"] if frequency is None else frequency
    branches = []
    for k in CLOSED:
        if k not in kinds:
            continue
        if k in CARRIERS:
            y = carrier(k, t, p, frequency, phase, duty, width)
        elif k == "dirichlet":
            y = dirichlet_kernel(theta(t, p["n"], f), p["periodicity"]) * _c(p["amplitude"])
        elif k == "polynomial":
            y = polynomial(t, p["coefficients"])
        else:
            step = F.greatest(F.floor(_c(p["n"]) / _c(p["frequency"])), F.lit(1))
            sign = F.when(uniform(p["seed"], "jump", p["random_seed"], F.floor(t / step).cast("long")) < 0.5, -1.0).otherwise(1.0)
            y = sign * (_c(p["channel_diff"]) * p["channel"] + _c(p["channel_offset"]))
        branches.append((k, y))
    out = F.lit(None).cast("double")
    for k, y in reversed(branches):
        out = F.when(p["kind"] == k, y).otherwise(out)
    return out


# --- periods, on the driver ------------------------------------------------------------


def periods(kind: str, n: int, p: dict) -> int | None:
    """Number of periods in n samples, None for kinds without."""
    f = p.get("frequency", 10.0)
    if kind in CARRIERS:
        return int(n / 100 * f)
    if kind == "dirichlet":
        return int(n / 100 * f) // (1 + (p.get("periodicity", 6) % 2 == 0))
    if kind == "ecg":
        return int((n // 100) * f)
    if kind == "mls":
        return n // (2 ** int(p.get("complexity", 7)) - 1)
    if kind == "random-mode-jump":
        return int(f)
    if kind == "cylinder-bell-funnel" and p.get("avg-pattern-length", 10) > 0:
        return n // int(p.get("avg-pattern-length", 10))
    return None


def period_size(kind: str, n: int, p: dict) -> int | None:
    """Samples in a period, None without periods."""
    if kind == "mls":
        return 2 ** int(p.get("complexity", 7)) - 1
    if kind == "random-mode-jump":
        return int(n // p.get("frequency", 10.0))
    k = periods(kind, n, p)
    return n // k if k is not None and k > 1 else None


def is_periodic(kind: str, n: int, p: dict) -> bool:
    """Whether windows of the kind can be re-evaluated at another frequency or shifted."""
    if kind in ("random-mode-jump", "cylinder-bell-funnel"):
        return False
    k = periods(kind, n, p)
    return k is not None and k > 1
