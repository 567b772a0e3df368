"""Slots for domain libraries that are not part of the engine, and rules over descriptor columns (UDF1 - UDF6)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

# Limits of the published drug-likeness rules as (least, most) per descriptor.
LIPINSKI = {"mol_weight": (None, 500), "logp": (None, 5), "h_donors": (None, 5), "h_acceptors": (None, 10)}
GHOSE = {"mol_weight": (160, 480), "logp": (-0.4, 5.6), "n_atoms": (20, 70), "molar_refractivity": (40, 130)}
VEBER = {"rotatable_bonds": (None, 10), "tpsa": (None, 140)}


def within(limits: dict[str, tuple[float | None, float | None]]) -> Column:
    """Whether all columns lie inside their inclusive limits; null if one is missing and none lies outside."""
    out = F.lit(True)
    for c, (lo, hi) in limits.items():
        if lo is not None:
            out = out & (F.col(c) >= lo)
        if hi is not None:
            out = out & (F.col(c) <= hi)
    return out


def structure_slot(convert: Callable[[str], str | None] | None = None) -> Callable[[Column], Column]:
    """Structure standardization: ``convert`` per distinct value of an Arrow batch, failures and nulls give the empty string; without it trimming."""
    if convert is None:
        return lambda c: F.trim(F.coalesce(c, F.lit("")))

    def one(x: str | None) -> str:
        try:
            return convert(x) or "" if x is not None else ""
        except Exception:  # noqa: BLE001 - a structure that can't be read is no error of the job
            return ""

    def run(s: pd.Series) -> pd.Series:
        done = {x: one(x) for x in s.unique()}
        return s.map(done).fillna("")

    return F.pandas_udf(run, StringType())


def descriptor_slot(compute: Callable[[str], list[float] | None]) -> Callable[[Column], Column]:
    """Descriptors of a structure as an array of doubles; null where the calculator fails."""

    def one(x: str | None) -> list[float] | None:
        try:
            return [float(v) for v in compute(x)] if x is not None else None
        except Exception:  # noqa: BLE001
            return None

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(run, ArrayType(DoubleType()))


def ngram_fingerprint(c: Column, n: int = 3, bits: int = 1024) -> Column:
    """Set bits of hashed character n-grams, sorted: the stand-in for a structure's fingerprint; null stays null, short texts have none."""
    grams = F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.pmod(F.xxhash64(F.substr(c, i, F.lit(n))), F.lit(bits)).cast(IntegerType()))).otherwise(F.array().cast("array<int>"))
    return F.when(c.isNotNull(), F.sort_array(F.array_distinct(grams)))
