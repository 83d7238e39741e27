"""Oscillations as columns of a time index: ``df.select(api.sine("t", length=1000, frequency=4))``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import oscillators as osc


def _make(kind: str):
    def make(t="t", length: int = 10000, **parameters) -> Column:
        from ..operators.series import NAMES, spec_row

        row = dict(zip(NAMES, spec_row({"kind": kind, **{k.replace("_", "-"): v for k, v in parameters.items()}}, "api", "api", 0, 0, length, parameters.get("seed", 0))))
        p = {k: F.lit(v) if v is not None else F.lit(None) for k, v in row.items()}
        p["coefficients"] = F.lit(row["coefficients"]).cast("array<double>")
        p["kind"] = F.lit(kind)
        t = F.col(t) if isinstance(t, str) else t
        if kind == "ecg":
            return osc.ecg_wave(t, length, row["frequency"]) * row["amplitude"]
        return osc.closed_form(t, p, kinds={kind})

    make.__name__ = kind.replace("-", "_")
    return make


sine, cosine, square, sawtooth, dirichlet, polynomial, random_mode_jump, ecg = (_make(k) for k in ("sine", "cosine", "square", "sawtooth", "dirichlet", "polynomial", "random-mode-jump", "ecg"))


def _frame(kind: str):
    def make(spark, length: int = 10000, seed=0, **parameters):
        from ..operators.series import samples, spec_row

        row = spec_row({"kind": kind, **{k.replace("_", "-"): v for k, v in parameters.items()}}, "api", "api", 0, 0, length, seed)
        return samples(spark, [row]).select("t", F.col("base").alias("value"))

    make.__name__ = kind.replace("-", "_")
    make.__doc__ = f"Samples (t, value) of a {kind} channel, whose values depend on their neighbours."
    return make


random_walk, cylinder_bell_funnel, mls = (_frame(k) for k in ("random-walk", "cylinder-bell-funnel", "mls"))


def formula(expression, *channels: Column, keys=()) -> Column:
    """A formula over columns: ``select(api.formula({"base": 0, "operation": {"kind": "+", "operand": {"base": 1}}}, F.col("a"), F.col("b")))``.

    Aggregations run over the rows of equal ``keys`` (all rows without any).
    """
    from pyspark.sql import Window

    from .formula import check, compile_formula

    check(expression)
    return compile_formula(expression, lambda c: channels[c], Window.partitionBy(*keys))
