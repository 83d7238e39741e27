"""Series from NumPy's bit generator instead of hashes, for comparison with published samples.

One generator for each series and split, seeded with [seed, MD5 of the name as a number
(and the split's number if it is not 0)], used in a fixed order: for each channel the
base's draws, those of its trends with their noise, and the noise; then for each anomaly
the position and the kinds. This is sequential within a series; series run in parallel.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from ..sources import config as cfg
from .placement import POSITIONS, TRIES, collides


def generator(seed: int, name: str, split: int = 0) -> np.random.Generator:
    parts = [seed, int.from_bytes(hashlib.md5(name.encode()).digest(), "big")] + ([split] if split else [])
    return np.random.default_rng(np.random.SeedSequence(parts))


def _theta(n: int, f: float) -> np.ndarray:
    return 2 * np.pi * f * np.linspace(0, n / 100, n)


def _bell(taps: int, last: float) -> np.ndarray:
    w = np.exp(-np.linspace(-1.5, last, taps) ** 2 / 2)
    return w / w.sum()


def _scaled(x: np.ndarray, a: float) -> np.ndarray:
    lo, hi = x.min(), x.max()
    return np.full(len(x), -a) if hi == lo else (x - lo) / (hi - lo) * 2 * a - a


def base(bo: dict, n: int, rng: np.random.Generator, f: float | None = None) -> np.ndarray:
    """The base of a closed-form or random-walk channel."""
    get = lambda k: cfg.DEFAULTS[k] if bo.get(k) is None else bo[k]
    kind, a = bo["kind"], float(get("amplitude"))
    th = _theta(n, get("frequency") if f is None else f)
    wrap = np.mod(th, 2 * np.pi)
    if kind in ("sine", "cosine"):
        wave = np.sin if kind == "sine" else np.cos
        return wave(th) * a * (wave(th * bo["freq-mod"]) if bo.get("freq-mod") else 1)
    if kind == "square":
        return np.where(wrap < 2 * np.pi * get("duty"), 1.0, -1.0) * a
    if kind == "sawtooth":
        w = get("width")
        down = (np.pi * (w + 1) - wrap) / (np.pi * (1 - w)) if w < 1 else np.ones(n)
        return np.where(wrap < 2 * np.pi * w, wrap / (np.pi * w) - 1 if w > 0 else 0, down) * a
    if kind == "dirichlet":
        m, half = get("periodicity"), np.sin(th / 2)
        near = np.abs(half) < 1e-9
        return np.where(near, (-1.0) ** (np.rint(th / (2 * np.pi)) * (m - 1)), np.sin(m * th / 2) / (m * np.where(near, 1, half))) * a
    if kind == "polynomial":
        return sum(c * np.arange(n, dtype=float) ** i for i, c in enumerate(get("polynomial")))
    if kind == "random-walk":
        taps = max(1, int(get("smoothing") * n)) if get("smoothing") else 1
        steps = rng.choice([-1.0, 0.0, 1.0], size=n + taps - 2)
        walk = np.concatenate(([0.0], steps)).cumsum()
        return _scaled(np.convolve(walk, _bell(taps, 1.5), "valid") if get("smoothing") else walk, a)
    raise cfg.ConfigError(f"{kind} has no exact mode")


def _channel(bo: dict, n: int, rng):
    x = base(bo, n, rng)
    trend = np.zeros(n)
    if bo.get("trend"):
        t, deeper, _ = _channel(bo["trend"], n, rng)
        trend = t + deeper
    get = lambda k: cfg.DEFAULTS[k] if bo.get(k) is None else bo[k]
    return x, trend, rng.normal(0, get("variance") * get("amplitude"), n)


def series_values(ts: dict, seed: int, split: int = 0):
    """Values (n x channels) and labels of one checked series; kinds: mean, platform, extremum, amplitude with creeping."""
    n, rng = ts["length"], generator(seed, ts["name"], split)
    parts = [_channel(bo, n, rng) for bo in ts["channels"]]
    out = np.stack([p[0] for p in parts], axis=1)
    trends = [p[1].copy() for p in parts]
    labels, taken = np.zeros(n, np.int8), []
    for a in ts["anomalies"]:
        x, noise = parts[a["channel"]][0], parts[a["channel"]][2]
        if a["exact"] is not None:
            s = int(a["exact"])
        else:
            for _ in range(TRIES):
                section = n // 3
                s = POSITIONS.index(a["position"]) * section + int(rng.choice(np.arange(section)))
                if s + a["length"] < n and not collides((s, s + a["length"]), taken, True):
                    break
            else:
                raise ValueError("no free position")
        e = s + a["length"]
        new = []
        for k in a["kinds"]:
            ramp = np.concatenate((np.linspace(0, 1, a["creeping"]), np.ones(e - s - a["creeping"])))
            if k["kind"] == "mean":
                new.append(x[s:e] + k["offset"] * ramp)
            elif k["kind"] == "platform":
                new.append(np.full(e - s, float(k["value"])))
                trends[a["channel"]][s:e] = 0
            elif k["kind"] == "extremum":
                e = s + 1
                if k["local"]:
                    w = k["context_window"] // 2
                    near = x[max(0, s - w) : min(n, e + w)]
                    size = rng.random() * (near.max() - near.min())
                else:
                    size = (rng.random() + 0.5) * (x.max() - x.min())
                top = np.abs(noise).max()
                size += 2 * top if size < 2 * top else 0
                new.append(np.array([x[s] - size if k["min"] else x[s] + size]))
            else:
                raise cfg.ConfigError(f"{k['kind']} has no exact mode")
        out[s:e, a["channel"]] = np.sum(new, axis=0)
        labels[s:e] = 1
        taken.append((s, e))
    for c, (_, _, noise) in enumerate(parts):
        out[:, c] += noise + trends[c] + float(ts["channels"][c].get("offset") or 0)
    return out, labels


def samples(spark: SparkSession, config, seed: int = 42) -> DataFrame:
    """series, channel, t, value, is_anomaly of all series of a configuration, test split."""
    ship(spark)
    checked = {ts["name"]: ts for ts in cfg.normalise(cfg.load(config))}
    names = spark.createDataFrame([(n,) for n in checked], "series string").repartition(max(1, min(len(checked), 256)), "series")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name in b.column("series").to_pylist():
                values, labels = series_values(checked[name], seed)
                n = len(labels)
                for c in range(values.shape[1]):
                    yield pa.RecordBatch.from_pydict({"series": [name] * n, "channel": np.full(n, c, np.int32), "t": np.arange(n), "value": values[:, c], "is_anomaly": labels.astype(np.int32)})

    return names.mapInArrow(run, "series string, channel int, t long, value double, is_anomaly int")


__all__ = ["F", "generator", "samples", "series_values"]
