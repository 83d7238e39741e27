"""Oscillation and anomaly kinds of one's own."""

from __future__ import annotations

from ..operators import anomalies, series
from ..sources import config


def register_oscillation(kind: str, build) -> None:
    """Adds an oscillation kind.

    ``build`` gets a frame with one row for each channel of the kind (``operators.series.SPEC``)
    and returns those columns with ``t`` (0 .. n - 1) and ``base``. Anomalies that do not ask for
    periods are allowed on it.
    """
    series.register(kind, build)


def register_anomaly(kind: str, rewrite, parameters: dict | None = None, allowed=config.KINDS) -> None:
    """Adds an anomaly kind.

    ``rewrite`` gets the base column, the place in the window, its length and a mapping of
    the kind's parameters (numbers with defaults in ``parameters``) and returns the new base column. It
    may use windows over ``operators.anomalies.EVENT``, which is the anomaly.
    """
    if kind in config.ANOMALIES and kind not in anomalies.REGISTERED:
        raise ValueError(f"{kind!r} is a built-in anomaly")
    config.add_anomaly(kind, parameters or {}, tuple(allowed))
    anomalies.REGISTERED[kind] = (rewrite, sorted(parameters or {}))
