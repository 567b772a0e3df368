"""Numeric expressions with the missing-value rules of the engine: NaN is read as null at the boundary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(c: Column) -> Column:
    """Null for NaN."""
    return F.when(~F.isnan(c), c)


def is_inf(c: Column) -> Column:
    return F.coalesce(F.abs(c) == F.lit(float("inf")), F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def p_scale(c: Column, per_molar: float = 1e9) -> Column:
    """-log10 of a concentration given in 1/``per_molar`` mol; null for null and non-positive values."""
    return F.when(c > 0, -F.log10(c / F.lit(per_molar)))


def classify(c: Column, thresholds: list[float], right: bool = True) -> Column:
    """Number of thresholds below ``c`` (``right``: equal values belong to the lower class); null stays null."""
    return F.when(c.isNotNull(), sum(((c > t) if right else (c >= t)).cast("int") for t in sorted(thresholds)))


def predict_binding(activity: Column, conc: Column, ki_to_ic50: float = 1.0) -> Column:
    """Fraction bound at a concentration in nM, from an activity on the p scale; null for a concentration of 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.try_divide(F.pow(F.lit(10.0), F.lit(9.0) - activity) * F.lit(ki_to_ic50), conc))


def argmax_class(p: Column) -> Column:
    """Index (from 0) of the first largest probability; null for null or empty arrays."""
    return F.when(F.size(p) > 0, F.array_position(p, F.array_max(p)).cast("int") - 1)
