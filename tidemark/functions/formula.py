"""Formulas over earlier channels, compiled to column expressions.

A formula is a mapping: ``base`` (a channel number, a number as ``{"value": x}``, or another
formula) with either ``operation`` {kind, operand} or ``aggregation`` {kind}. Operations
are elementwise; an aggregation is one number for the whole series, repeated at every sample.
Division by zero gives what floating point gives: an infinity or NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATIONS = ("+", "-", "*", "/", "**")
AGGREGATIONS = ("sum", "min", "max", "median", "std", "var")


def check(formula) -> None:
    """Raises ValueError for a formula that is not well-formed."""
    if isinstance(formula, (int, float)) and not isinstance(formula, bool):
        return
    if not isinstance(formula, dict) or "base" not in formula:
        raise ValueError(f"a formula needs a base: {formula!r}")
    if "operation" in formula and "aggregation" in formula:
        raise ValueError("a formula has an operation or an aggregation, not both")
    check(formula["base"])
    if "operation" in formula:
        op = formula["operation"]
        if op.get("kind") not in OPERATIONS:
            raise ValueError(f"unknown operation: {op.get('kind')!r}")
        check(op["operand"])
    if "aggregation" in formula and formula["aggregation"].get("kind") not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {formula['aggregation'].get('kind')!r}")


def channels(formula) -> set[int]:
    """The channels a formula refers to."""
    if isinstance(formula, dict):
        own = {formula["base"]} if isinstance(formula["base"], int) else channels(formula["base"])
        return own | (channels(formula["operation"]["operand"]) if "operation" in formula and isinstance(formula["operation"]["operand"], dict) else set())
    return set()


def divide(a: Column, b: Column) -> Column:
    """Floating-point division."""
    safe = a / F.when(b != 0, b)
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b != 0, safe).otherwise(zero)


def compile_formula(formula, channel, window) -> Column:
    """The formula as a column. ``channel``: number -> column; ``window``: the whole series' window."""
    base = channel(formula["base"]) if isinstance(formula["base"], int) else (F.lit(float(formula["base"])) if isinstance(formula["base"], float) else compile_formula(formula["base"], channel, window))
    if "operation" in formula:
        kind, operand = formula["operation"]["kind"], formula["operation"]["operand"]
        other = compile_formula(operand, channel, window) if isinstance(operand, dict) else F.lit(float(operand))
        if kind == "+":
            return base + other
        if kind == "-":
            return base - other
        if kind == "*":
            return base * other
        return divide(base, other) if kind == "/" else F.pow(base, other)
    if "aggregation" in formula:
        agg = {"sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_pop, "var": F.var_pop}
        return agg[formula["aggregation"]["kind"]](base).over(window)
    return base
