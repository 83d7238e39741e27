"""Generation configurations: reading, checking, defaults and the compatibility relation."""

from __future__ import annotations

import copy
import json
from pathlib import Path

from ..functions import formula as fx

#: The oscillation kinds.
KINDS = ("sine", "cosine", "square", "sawtooth", "dirichlet", "random-walk", "cylinder-bell-funnel", "ecg", "polynomial", "random-mode-jump", "mls", "formula", "custom-input")
#: The anomaly kinds.
ANOMALIES = ("amplitude", "extremum", "frequency", "mean", "pattern", "pattern-shift", "platform", "trend", "variance", "mode-correlation")
POSITIONS = ("beginning", "middle", "end")
#: Defaults of the parameters.
DEFAULTS = {
    "length": 10000, "frequency": 10.0, "amplitude": 1.0, "variance": 0.0, "avg-pattern-length": 10, "variance-pattern-length": 0.0,
    "variance-amplitude": 2.0, "freq-mod": 0.0, "polynomial": [1, 1], "smoothing": 0.01, "channel-diff": 0.0, "width": 1.0, "duty": 0.5,
    "periodicity": 6, "complexity": 7, "offset": 0.0, "phase": 0.0, "random-seed": 0,
}
#: What an anomaly kind's parameters are and their defaults.
KIND_DEFAULTS = {
    "amplitude": {"amplitude_factor": 1.0, "transition_length": None},
    "extremum": {"min": False, "local": False, "context_window": 10},
    "frequency": {"frequency_factor": 1.0},
    "mean": {"offset": 0.0},
    "pattern": {"sinusoid_k": 10.0, "cbf_pattern_factor": 2.0, "square_duty": 1.0, "sawtooth_width": 0.5, "min_effect_delta": 0.0, "min_window_ptp": 0.0, "adaptive_blend": False, "blend_strength": 1.0},
    "pattern-shift": {"shift_by": 5, "transition_window": 10, "crossfade_mode": "cosine", "min_effect_delta": 0.0},
    "platform": {"value": 0.0, "min_effect_delta": 0.0},
    "trend": {"oscillation": None, "transition_length": None, "boundary_mode": "inside_window_zero_endpoints", "envelope_kind": "sine2", "min_effect_delta": 0.0},
    "variance": {"variance": 0.0, "min_effect_delta": 0.0},
    "mode-correlation": {},
}
#: Kinds whose windows begin with a period where the series has more than six.
PERIOD_STARTS = ("frequency", "pattern", "pattern-shift", "mode-correlation")
_PERIODIC = ("sine", "cosine", "square", "sawtooth", "dirichlet", "ecg")
_NOT_JUMP = tuple(k for k in KINDS if k != "random-mode-jump")
#: The oscillations each anomaly kind is allowed on.
ALLOWED = {
    "amplitude": tuple(k for k in _NOT_JUMP if k not in ("polynomial", "formula")),
    "extremum": _NOT_JUMP,
    "mean": _NOT_JUMP,
    "platform": _NOT_JUMP,
    "trend": _NOT_JUMP,
    "variance": _NOT_JUMP,
    "frequency": _PERIODIC,
    "pattern-shift": _PERIODIC,
    "pattern": (*_PERIODIC, "cylinder-bell-funnel", "mls"),
    "mode-correlation": ("random-mode-jump",),
}


def add_kind(kind: str) -> None:
    """Makes a registered oscillation known: anomalies that are no matter of periods are allowed on it."""
    global KINDS
    if kind not in KINDS:
        KINDS = (*KINDS, kind)
        for a in ("amplitude", "extremum", "mean", "platform", "trend", "variance"):
            ALLOWED[a] = (*ALLOWED[a], kind)


def add_anomaly(name: str, parameters: dict, allowed: tuple[str, ...]) -> None:
    """Makes a registered anomaly known: its parameters with defaults, and the oscillations it is allowed on."""
    global ANOMALIES
    if name not in ANOMALIES:
        ANOMALIES = (*ANOMALIES, name)
    KIND_DEFAULTS[name] = dict(parameters)
    ALLOWED[name] = tuple(allowed)


def compatible(anomaly: str, kind: str) -> bool:
    return kind in ALLOWED.get(anomaly, ())


def compat_frame(spark):
    """The allowed (anomaly, base) pairs."""
    return spark.createDataFrame([(a, k) for a, ks in ALLOWED.items() for k in ks], "anomaly string, base string")


class ConfigError(ValueError):
    """A configuration that can't be run, with the place of the fault."""


def load(source) -> dict:
    """A configuration from a mapping, or from a YAML or JSON file."""
    if isinstance(source, dict):
        return copy.deepcopy(source)
    path = Path(source)
    text = path.read_text()
    if path.suffix == ".json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def _channels(ts: dict, where: str) -> list[dict]:
    if "base-oscillations" in ts:
        return ts["base-oscillations"]
    if "base-oscillation" in ts:
        return [copy.deepcopy(ts["base-oscillation"]) for _ in range(int(ts.get("channels", 1)))]
    raise ConfigError(f"{where}: base-oscillations or base-oscillation is missing")


def _check_oscillation(bo: dict, where: str) -> None:
    kind = bo.get("kind")
    if kind not in KINDS:
        raise ConfigError(f"{where}: unknown oscillation {kind!r}")
    for name in ("frequency", "amplitude", "variance", "smoothing", "width", "duty"):
        if name in bo and (isinstance(bo[name], bool) or not isinstance(bo[name], (int, float))):
            raise ConfigError(f"{where}.{name}: a number is expected")
    if kind == "mls" and not 1 < bo.get("complexity", 7) < 16:
        raise ConfigError(f"{where}.complexity: more than 1 and less than 16 is expected")
    if kind == "dirichlet" and not bo.get("periodicity", 6) > 1:
        raise ConfigError(f"{where}.periodicity: more than 1 is expected")
    if kind == "formula":
        try:
            fx.check(bo.get("formula"))
        except ValueError as e:
            raise ConfigError(f"{where}.formula: {e}") from None
    if "trend" in bo and bo["trend"]:
        _check_oscillation(bo["trend"], f"{where}.trend")


def _kind(raw: dict, where: str) -> dict:
    name = raw.get("kind")
    if name not in ANOMALIES:
        raise ConfigError(f"{where}: unknown anomaly {name!r}; it is one of {', '.join(ANOMALIES)}")
    given = {k.replace("-", "_"): v for k, v in raw.items() if k != "kind"}
    if unknown := set(given) - set(KIND_DEFAULTS[name]):
        raise ConfigError(f"{where}: {name} has no parameter {sorted(unknown)[0]!r}")
    return {"kind": name, **KIND_DEFAULTS[name], **given}


def normalise(config: dict, only: str | None = None, skip_errors: bool = False) -> list[dict]:
    """Checked series with all defaults filled in.

    ``only`` keeps the series of one name. With ``skip_errors``, an anomaly kind that is
    not allowed on its channel is left out instead of an error.
    """
    if not isinstance(config, dict) or not isinstance(config.get("timeseries"), list) or not config["timeseries"]:
        raise ConfigError("timeseries: a list with one entry at least is expected")
    out, names = [], set()
    for i, ts in enumerate(config["timeseries"]):
        name = ts.get("name", f"ts_{i}")
        where = f"timeseries[{i}]"
        if only is not None and name != only:
            continue
        if name in names:
            raise ConfigError(f"{where}.name: {name!r} occurs twice")
        names.add(name)
        length = ts.get("length", DEFAULTS["length"])
        if not isinstance(length, int) or length < 1:
            raise ConfigError(f"{where}.length: a positive whole number is expected")
        channels = _channels(ts, where)
        for c, bo in enumerate(channels):
            _check_oscillation(bo, f"{where}.base-oscillations[{c}]")
            if bo["kind"] == "formula" and any(x >= c for x in fx.channels(bo["formula"])):
                raise ConfigError(f"{where}.base-oscillations[{c}].formula: only earlier channels can be used")
        anomalies = []
        for k, a in enumerate(ts.get("anomalies") or []):
            at = f"{where}.anomalies[{k}]"
            if "length" not in a:
                raise ConfigError(f"{at}.length: missing")
            channel = a.get("channel", 0)
            if not 0 <= channel < len(channels):
                raise ConfigError(f"{at}.channel: there is no channel {channel}")
            if a.get("position", "middle") not in POSITIONS:
                raise ConfigError(f"{at}.position: one of {', '.join(POSITIONS)} is expected")
            kinds = []
            for j, raw in enumerate(a.get("kinds") or []):
                kind = _kind(raw, f"{at}.kinds[{j}]")
                if not compatible(kind["kind"], channels[channel]["kind"]):
                    if skip_errors:
                        continue
                    raise ConfigError(f"{at}.kinds[{j}]: {kind['kind']} is not allowed on {channels[channel]['kind']}")
                kinds.append(kind)
            if kinds or not a.get("kinds"):
                anomalies.append({"length": int(a["length"]), "position": a.get("position", "middle"), "exact": a.get("exact-position"), "channel": channel, "creeping": int(a.get("creeping-length", 0)), "kinds": kinds})
        out.append({"name": name, "length": length, "channels": copy.deepcopy(channels), "anomalies": anomalies, "supervised": bool(ts.get("supervised")), "semi_supervised": bool(ts.get("semi-supervised")), "generation_id": i})
    return out
