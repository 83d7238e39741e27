"""Positions of anomalies, drawn on the driver: their number is bounded by the configuration."""

from __future__ import annotations

from ..functions import oscillators as osc
from ..functions.rng import draw
from ..sources.config import PERIOD_STARTS, POSITIONS

TRIES = 50


def collides(window: tuple[int, int], taken: list[tuple[int, int]], compat: bool = False) -> bool:
    """Whether a window meets an earlier one. ``compat``: only if an end point lies in one (closed intervals), so one that contains another is missed."""
    s, e = window
    if compat:
        return any(a <= s <= b or a <= e <= b for a, b in taken)
    return any(s <= b and a <= e for a, b in taken)


def candidate(anomaly: dict, channel: dict, n: int, u: float) -> tuple[int, int]:
    """One drawn window: in its third of the series, at the start of a period if a kind asks for it."""
    third = POSITIONS.index(anomaly["position"])
    size, count = osc.period_size(channel["kind"], n, channel), osc.periods(channel["kind"], n, channel)
    if any(k["kind"] in PERIOD_STARTS for k in anomaly["kinds"]) and count is not None and count > 6 and size is not None and size > 2:
        per = int(count) // 3
        start = size * (third * per + (int(u * per) if per > 1 else 0))
    else:
        section = n // 3
        start = third * section + int(u * section)
    return start, start + anomaly["length"]


def place(ts: dict, split: str, seed, compat: bool = False) -> list[tuple[int, int]]:
    """A window for each anomaly of a series; ValueError if 50 draws find no free one."""
    taken: list[tuple[int, int]] = []
    n = ts["length"]
    for k, a in enumerate(ts["anomalies"]):
        length = 1 if any(x["kind"] == "extremum" for x in a["kinds"]) else a["length"]
        if a["exact"] is not None:
            window = (int(a["exact"]), int(a["exact"]) + a["length"])
        else:
            for j in range(TRIES):
                window = candidate(a, ts["channels"][a["channel"]], n, draw(seed, ts["name"], split, "position", k, j))
                if window[1] < n and not collides(window, taken, compat):
                    break
            else:
                raise ValueError(f"no free position in {TRIES} draws for an anomaly of {a['length']} samples at the {a['position']} of channel {a['channel']} in {ts['name']}")
        window = (window[0], window[0] + length if length == 1 else window[1])
        taken.append(window)
    return taken
