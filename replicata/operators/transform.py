"""Normalization with missing data, class weights, imputation, resampling (XF)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicata.functions.numbers import no_nan
from replicata.operators.joins import with_ordinal

_HUGE = 1e30


def y_stats(df: DataFrame, tasks: list[str], by: list[str] | None = None) -> DataFrame:
    """XF1: one row (per group) ``mean_<task>, std_<task>`` over present values: population deviation, 0 below two values, mean 0 without any."""
    agg = []
    for t in tasks:
        c = no_nan(F.col(t).cast("double"))
        agg += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{t}"), F.when(F.count(c) >= 2, F.stddev_pop(c)).otherwise(0.0).alias(f"std_{t}")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def _scale(std: Column) -> Column:
    return F.when(std == 0, 1.0).otherwise(std)


def normalize_y(df: DataFrame, tasks: list[str], stats: DataFrame | None = None) -> DataFrame:
    """XF2: responses minus mean over deviation (0 counts as 1); missing ones become 0, as their weight is 0."""
    s = F.broadcast(stats if stats is not None else y_stats(df, tasks))
    return df.crossJoin(s).select(*[c for c in df.columns if c not in tasks], *[F.coalesce((no_nan(F.col(t)) - F.col(f"mean_{t}")) / _scale(F.col(f"std_{t}")), F.lit(0.0)).alias(t) for t in tasks])


def untransform_y(df: DataFrame, tasks: list[str], stats: DataFrame) -> DataFrame:
    """XF2: the inverse for predictions."""
    return df.crossJoin(F.broadcast(stats)).select(*[c for c in df.columns if c not in tasks], *[(F.col(t) * _scale(F.col(f"std_{t}")) + F.col(f"mean_{t}")).alias(t) for t in tasks])


def array_moments(df: DataFrame, features: str, label: str | None = None) -> DataFrame:
    """``label, feature, n, mean, m2``: count, mean and squared deviations from it by place of an array and by an integer label (missing label: -1; without one 0).

    Missing numbers are left out, arrays may differ in length.  A task merges its batches as matrices, so that rows are not multiplied by features; one row per
    task, label and feature is shuffled.
    """
    from replicata.plans.storage import materialize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.diff(b.column("v").offsets.to_numpy())
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
            x = np.full((b.num_rows, int(sizes.max(initial=0))), np.nan)
            x[np.arange(x.shape[1])[None, :] < sizes[:, None]] = flat
            labels = b.column("y").to_numpy(zero_copy_only=False)
            for y in np.unique(labels).tolist():
                part = x[labels == y]
                n = (~np.isnan(part)).sum(0).astype(float)
                mean = np.nansum(part, axis=0) / np.maximum(n, 1)
                m2 = np.nansum((part - mean) ** 2, axis=0)
                if y in held:
                    w = max(len(n), len(held[y][0]))
                    (n, mean, m2), (n1, mean1, m21) = ([np.pad(v, (0, w - len(v))) for v in side] for side in ((n, mean, m2), held[y]))
                    total, d = np.maximum(n + n1, 1), mean - mean1
                    n, mean, m2 = n + n1, mean1 + d * n / total, m2 + m21 + d * d * n * n1 / total
                held[y] = [n, mean, m2]
        for y, (n, mean, m2) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), y, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(m2)], ["label", "feature", "n", "mean", "m2"])

    y = F.coalesce(F.col(label).cast("int"), F.lit(-1)) if label else F.lit(0)
    rows = df.filter(F.col(features).isNotNull()).select(F.transform(features, lambda x: x.cast("double")).alias("v"), y.alias("y"))
    return merged_moments(materialize(rows.mapInArrow(run, "label int, feature int, n bigint, mean double, m2 double")), ["label", "feature"])


def merged_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """``*by, n, mean, m2`` of moments that belong together; parts without values count for nothing."""
    own = parts.filter("n > 0")
    mean = own.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m"))
    return own.join(mean, by).groupBy(*by).agg(F.sum("n").alias("n"), F.max("_m").alias("mean"), F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m"))).alias("m2"))


def x_stats(df: DataFrame, features: str) -> DataFrame:
    """One row ``means, stds`` of an array column by place; missing values are left out, a place without any has mean and std 0."""
    per = array_moments(df, features)
    last = per.agg(F.coalesce(F.max("feature"), F.lit(-1)).alias("last"))
    # One entry per feature, not per row; places without a value have no moments.
    found = per.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"))))).alias("m"))
    places = F.when(F.col("last") >= 0, F.sequence(F.lit(0), F.col("last"))).otherwise(F.array().cast("array<int>"))
    take = lambda c: F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i)[c], F.lit(0.0)))
    return found.crossJoin(last).select(take("mean").alias("means"), take("std").alias("stds"))


def normalize_x(df: DataFrame, features: str, stats: DataFrame | None = None) -> DataFrame:
    """XF2: features minus mean over deviation; 0 where the deviation is 0 or the value missing; sizes are cut at 1e30, keeping the sign."""
    s = F.broadcast(stats if stats is not None else x_stats(df, features))
    z = F.zip_with(F.zip_with(F.col(features), "means", lambda x, m: no_nan(x.cast("double")) - m), "stds", lambda x, s: F.when(s == 0, 0.0).otherwise(x / s))
    return df.crossJoin(s).withColumn(features, F.transform(z, lambda x: F.greatest(F.least(F.coalesce(x, F.lit(0.0)), F.lit(_HUGE)), F.lit(-_HUGE)))).drop("means", "stds")


def normalize_hybrid(df: DataFrame, value: str, conc: str) -> DataFrame:
    """XF3: activities (no concentration) are normalized, single-dose values clipped to [0.001, 0.999]; single doses of a mean above 2 fail the job."""
    v, c = no_nan(F.col(value)), F.col(conc)
    s = df.agg(F.avg(F.when(c.isNull(), v)).alias("_m"), F.stddev_pop(F.when(c.isNull(), v)).alias("_s"), F.avg(F.when(c.isNotNull(), v)).alias("_d"))
    single = F.when(F.col("_d") > 2, F.raise_error(F.lit("single-dose values are no fractions"))).otherwise(F.greatest(F.least(v, F.lit(0.999)), F.lit(0.001)))
    return df.crossJoin(F.broadcast(s)).withColumn(value, F.when(c.isNull(), (v - F.col("_m")) / _scale(F.col("_s"))).otherwise(single)).drop("_m", "_s", "_d")


def balancing_weights(df: DataFrame, label: str) -> DataFrame:
    """XF5: adds ``weight`` = rows / rows of the class, so that classes weigh alike; missing labels weigh 0."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    return df.join(counts, label, "left").crossJoin(F.broadcast(total)).withColumn("weight", F.coalesce(F.col("_t") / F.col("_n"), F.lit(0.0))).drop("_n", "_t")


def fold_stats(df: DataFrame, tasks: list[str], fold: str, folds: int) -> DataFrame:
    """XF6: statistics of each fold's training rows (those of the other folds), one pass over the data."""
    every = df.withColumn("_f", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold))))
    return y_stats(every, tasks, ["_f"]).withColumnRenamed("_f", "fold")


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """XF7: missing values become the column's mean (null if the column has none)."""
    m = df.agg(*[F.avg(no_nan(F.col(c))).alias(f"_{c}") for c in columns])
    return df.crossJoin(F.broadcast(m)).withColumns({c: F.coalesce(no_nan(F.col(c)), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def undersample(df: DataFrame, key: str, label: str, majority: object, n: int, seed: int = 0) -> DataFrame:
    """XF9: all rows of other classes and ``n`` rows of the majority class, by the hash of their key; the same ones on every run."""
    big = df.filter(F.col(label) == F.lit(majority)).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    kept = with_ordinal(big, "_h", key).filter(F.col("ordinal") < n).drop("_h", "ordinal")
    return df.filter(~F.coalesce(F.col(label) == F.lit(majority), F.lit(False))).unionByName(kept)


def smote(df: DataFrame, key: str, features: str, label: str, minority: object, per_row: int = 1, k: int = 5, seed: int = 0) -> DataFrame:
    """XF8: synthetic minority rows between a row and one of its k nearest: ``key`` (text ``synthetic_<key>_<i>``), features, label, ``weight`` 1.

    Neighbour and place between the two come from hashes of key, number and seed; a minority of one row gives none.
    """
    from replicata.operators.distance import nearest

    few = df.filter(F.col(label) == F.lit(minority)).select(F.col(key).alias("id"), F.col(features).alias("v"))
    near = nearest(few, few, k, "euclidean", skip_self=True).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("l"))
    draw = near.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))))
    pick = F.element_at("l", (F.pmod(F.xxhash64("query_id", "i", F.lit(seed)), F.size("l")) + 1).cast("int"))["id"]
    place = F.pmod(F.xxhash64("query_id", "i", F.lit(seed + 1)), F.lit(1_000_000)) / 1_000_000
    pairs = draw.select("query_id", "i", pick.alias("other"), place.alias("t"))
    a, b = few.select(F.col("id").alias("query_id"), F.col("v").alias("va")), few.select(F.col("id").alias("other"), F.col("v").alias("vb"))
    return pairs.join(a, "query_id").join(b, "other").select(F.concat_ws("_", F.lit("synthetic"), "query_id", "i").alias(key), F.zip_with("va", "vb", lambda x, y: x + (y - x) * F.col("t")).alias(features), F.lit(minority).alias(label), F.lit(1.0).alias("weight"))
