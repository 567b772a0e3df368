"""Joins and set operations between tables of measurements, splits, features and models (JN, SET, PRJ11)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replicata.functions.numbers import all_of


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``ordinal``, 0, 1, ... in the order of the columns, without one task for all rows.

    Rows get their place in a range-sorted partition; the partitions' sizes are prefix-summed (one row per partition).
    """
    from replicata.plans.range_scan import range_sorted
    from replicata.plans.storage import materialize

    local = materialize(range_sorted(df, *order).withColumn("_id", F.monotonically_increasing_id()))
    sizes = local.groupBy(F.shiftright("_id", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = local.withColumn("_p", F.shiftright("_id", 33)).join(F.broadcast(before), "_p")
    return placed.withColumn("ordinal", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_p", "_id", "_before")


def restore_order(rows: DataFrame, key: str, predictions: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ11: every input row with its ordinal and its prediction, null where it was not scored."""
    return with_ordinal(rows.select(key), key).join(predictions, key, "left").select("ordinal", key, *columns)


def label_split(df: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """JN2: rows with their subset and fold, null outside the split."""
    return df.join(split.select(key, "subset", "fold"), key, "left")


def select_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN12: rows whose key is in the list, each once, however often the list has it."""
    return df.join(ids.select(key), key, "left_semi")


def compute_missing(df: DataFrame, key: str, known: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """JN5: features of every row: known ones are looked up, others computed once per distinct key."""
    todo = df.filter(F.col(key).isNotNull()).select(key).distinct().join(known.select(key), key, "left_anti")
    return df.join(known.dropDuplicates([key]).unionByName(compute(todo)), key, "left")


_MERGE: dict[str, Callable] = {
    "list": lambda v: F.array_sort(F.collect_list(v)),
    "uniquelist": lambda v: F.array_sort(F.collect_set(v)),
    "mean": F.avg,
    "geomean": lambda v: F.exp(F.avg(F.when(v > 0, F.ln(v)))),
    "median": F.median,
    "max": F.max,
    "min": F.min,
}


def merge_sources(sources: list[DataFrame], key: str, identifier: str, value: str, how: str) -> DataFrame:
    """JN6: one row per key over all sources: the smallest identifier, and the values merged by ``how``.

    ``how``: list, uniquelist, mean, geomean (of positive values), median, mode (ties: the smaller), max, min.  Sources are stacked and aggregated
    once instead of being joined in a chain; missing keys drop out, missing values are ignored.
    """
    rows = reduce(DataFrame.unionByName, [s.select(key, identifier, value) for s in sources]).filter(F.col(key).isNotNull())
    if how == "mode":
        n = rows.groupBy(key, value).agg(F.count(value).alias("_n"), F.min(identifier).alias(identifier))
        return n.groupBy(key).agg(F.min(identifier).alias(identifier), F.min(F.when(F.col(value).isNotNull(), F.struct(-F.col("_n"), F.col(value)))).getField(value).alias(value))
    return rows.groupBy(key).agg(F.min(identifier).alias(identifier), _MERGE[how](F.col(value)).alias(value))


def shared_keys(sources: list[DataFrame], key: str) -> DataFrame:
    """JN7: distinct keys that every source has."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), sources[1:], sources[0].select(key).distinct())


def natural_join(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """JN9: join over all common columns; missing values match missing values."""
    common = [c for c in a.columns if c in b.columns]
    x, y = a.alias("x"), b.alias("y")
    return x.join(y, all_of([F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in common]), how).select("x.*", *[f"y.{c}" for c in b.columns if c not in common])


def compare_splits(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """SET5: per subset and fold the sizes of both splits and the keys that only one of them has."""
    cols = [key, "subset", "fold"]
    both = a.select(*cols).distinct().withColumn("in_a", F.lit(1)).unionByName(b.select(*cols).distinct().withColumn("in_a", F.lit(0)))
    per = both.groupBy(*cols).agg(F.max("in_a").alias("a"), (1 - F.min("in_a")).alias("b"))
    return per.groupBy("subset", "fold").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))


def combined_training(split: DataFrame, key: str, unseen: DataFrame | None = None) -> DataFrame:
    """SET6: train and valid keys of fold 0; with resampled rows those of other folds that fold 0 lacks."""
    base = split.filter("fold = 0 and subset in ('train', 'valid')").select(key).distinct()
    return base if unseen is None else base.unionByName(unseen.select(key).distinct().join(base, key, "left_anti"))
