"""Small operators over frames of measurements, features, splits and model documents: sources, projections, joins, tables of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicata.functions.numbers import all_of, no_nan, p_scale


def potency_source(df: DataFrame, key: str, value: str, endpoint: str, endpoints: list[str], out: str = "pvalue", *keep: str) -> DataFrame:
    """SRC12: rows of known endpoints with a key and a positive value in nM: ``*keep, key``, and the value on the p scale; missing values drop out."""
    v = no_nan(F.col(value).cast("double"))
    return df.filter(F.col(endpoint).isin(endpoints) & F.col(key).isNotNull() & (v > 0)).select(*keep, F.col(key).alias("key"), p_scale(v).alias(out))


def with_p_scale(df: DataFrame, value: str, out: str) -> DataFrame:
    """PRJ3: adds a concentration in nM on the p scale; null for missing and non-positive values."""
    return df.withColumn(out, p_scale(no_nan(F.col(value).cast("double"))))


def feature_array(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """PRJ6: adds an array of doubles from numeric columns in the order given; missing numbers stay missing in their place."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))


def per_unit(df: DataFrame, columns: dict[str, str], by: str) -> DataFrame:
    """PRJ8: adds columns divided by another one (new name -> column); null where that is 0 or missing."""
    return df.withColumns({n: F.try_divide(F.col(c), F.col(by)) for n, c in columns.items()})


def wide_predictions(df: DataFrame, key: str, task: str, pred: str, tasks: list[str]) -> DataFrame:
    """PRJ9: one row per key with ``<task>_pred`` and ``<task>_std``, mean and population deviation of the task's predictions; tasks not listed are left out."""
    p = no_nan(F.col(pred).cast("double"))
    return df.groupBy(key).agg(*[f(F.when(F.col(task) == t, p)).alias(f"{t}_{n}") for t in tasks for n, f in (("pred", F.avg), ("std", F.stddev_pop))])


def class_predictions(df: DataFrame, probs: str, task: str) -> DataFrame:
    """PRJ9: adds ``<task>_pred``, the first largest class, and ``<task>_prob``, its probability."""
    from replicata.functions.numbers import argmax_class

    return df.withColumns({f"{task}_pred": argmax_class(F.col(probs)), f"{task}_prob": F.array_max(probs)})


def explode_lists(df: DataFrame, keep: list[str], *arrays: str) -> DataFrame:
    """PRJ14: parallel arrays side by side in rows; shorter ones are filled with nulls, rows without any give none."""
    return df.select(*keep, F.inline(F.arrays_zip(*arrays)))


def melt(df: DataFrame, keep: list[str], terms: dict[str, str], name: str = "term", value: str = "score") -> DataFrame:
    """PRJ15: columns (new name -> column) in long form; missing values keep their row."""
    return df.select(*keep, *[F.col(c).alias(n) for n, c in terms.items()]).unpivot(keep, list(terms), name, value)


def list_numbers(df: DataFrame, column: str, out: str = "numbers") -> DataFrame:
    """PRJ16: adds the numbers of a text separated by commas; what is no whole number is null, a missing text too."""
    return df.withColumn(out, F.transform(F.split(column, ","), lambda x: F.trim(x).try_cast("int")))


def list_stats(df: DataFrame, numbers: str) -> DataFrame:
    """PRJ16: adds ``n_layers, mean_size, product`` of an array of numbers; null if one of them is."""
    total = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.withColumns({"n_layers": F.size(numbers), "mean_size": F.try_divide(total, F.size(numbers)), "product": F.aggregate(numbers, F.lit(1).cast("bigint"), lambda a, x: a * x)})


def eligible(df: DataFrame, relation: str, barred: str, required: list[str], source: str, sources: list[str]) -> DataFrame:
    """FIL4: rows of known sources with all required values; a missing relation is not the barred one and stays."""
    return df.filter(~F.col(relation).eqNullSafe(barred) & all_of([F.col(c).isNotNull() for c in required]) & F.col(source).isin(sources))


def inner_with(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """JN3, JN11: inner join on a key; rows with a missing key, and those without a partner, drop out."""
    return df.join(other, key)


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """JN4, UDF6: every row with what a table has for its key, nulls where it has nothing."""
    return df.join(table, key, "left")


def unquoted(c: Column) -> Column:
    """JN8: a text without quotes."""
    return F.regexp_replace(c, "['\"]", "")


def present_in(left: DataFrame, right: DataFrame, key: str, in_left: str, in_right: str) -> DataFrame:
    """JN11: every key of either side once, and on which sides it is; missing keys drop out."""
    side = lambda d, n: d.filter(F.col(key).isNotNull()).select(key).distinct().withColumn(n, F.lit(True))
    both = side(left, in_left).join(side(right, in_right), key, "full_outer")
    return both.select(key, *[F.coalesce(n, F.lit(False)).alias(n) for n in (in_left, in_right)])


def outer_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """JN14: two curated targets side by side; keys of one side only have nulls on the other."""
    return left.join(right, keys, "full_outer")


def union_aggregate(sources: list[DataFrame], key: str, value: str, relation: str) -> DataFrame:
    """AGG1c: censored means over the distinct rows of several sources, with their common deviation of replicates."""
    from replicata.operators.curate import censored_means, replicate_rmsd

    u = reduce(DataFrame.unionByName, [s.select(key, value, relation) for s in sources]).distinct()
    return censored_means(u, key, value, relation, replicate_rmsd(u, key, value, relation))


def has_duplicates(df: DataFrame, column: str) -> DataFrame:
    """AGG13: one row ``has_dupes``: whether a value stands twice; missing values are left out.  Values are counted before the shuffle, not gathered."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).agg(F.coalesce(F.max("_n") > 1, F.lit(False)).alias("has_dupes"))


def collisions(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """AGG14: one row ``keys, features, collides``: whether there are not as many different features as keys."""
    k, f = F.count_distinct(key), F.count_distinct(*features)
    return df.agg(k.alias("keys"), f.alias("features"), (k != f).alias("collides"))


def group_weights(df: DataFrame, group: Column, out: str, weights: dict[str, str]) -> DataFrame:
    """AGG15: per group how many values each task has (new name -> task column)."""
    return df.groupBy(group.alias(out)).agg(*[F.count(c).alias(n) for n, c in weights.items()])


def percent_active(df: DataFrame, by: str, active: str) -> DataFrame:
    """AGG17: per group the percentage of active rows among those with a label; missing groups drop out."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg((100 * F.avg(active)).alias("pct_active"))


def distinct_counts(df: DataFrame, by: str, column: str, out: str) -> DataFrame:
    """AGG18: per group the different values of a column and the rows."""
    return df.groupBy(by).agg(F.count_distinct(column).alias(out), F.count("*").alias("n"))


def sort_by_score(df: DataFrame, score: str, identifier: str) -> DataFrame:
    """SRT1: rows by falling score, missing ones last, equal ones by identifier: a range sort."""
    return df.orderBy(F.col(score).desc_nulls_last(), identifier)


def distinct_keys(sources: list[tuple[DataFrame, str]], out: str = "key") -> DataFrame:
    """SET1: the different keys of several sources."""
    return reduce(DataFrame.union, [d.select(F.col(c).alias(out)) for d, c in sources]).distinct()


def keys_without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """SET3: rows whose key the other side lacks; missing keys stay."""
    return df.join(other.select(key), key, "left_anti")


def stack_sources(sources: dict[str, tuple[DataFrame, dict[str, str]]], out: str = "source") -> DataFrame:
    """SET4: sources (name -> frame and new name -> column) below each other under the leading names."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias(out), *[F.col(c).alias(k) for k, c in cols.items()]) for n, (d, cols) in sources.items()])


def describe_models(df: DataFrame, text: str, columns: list[str], missing: str = "unknown") -> Column:
    """REG5: a sentence about a model from columns that may be missing."""
    return F.format_string(text, *[F.coalesce(F.col(c), F.lit(missing)) for c in columns])


def best_model_errors(perf: DataFrame, groups: list[str], metric: str, identifier: str, pred: str, real: str) -> DataFrame:
    """REG8: the absolute error of the best model of each group: ``identifier, abs_error``."""
    from replicata.operators.registry import best_model

    best = best_model(perf, groups, metric, identifier).select(identifier)
    return perf.join(best, identifier, "left_semi").select(identifier, F.abs(F.col(pred) - F.col(real)).alias("abs_error"))


def expand_shortlist(shortlist: DataFrame, values: dict[str, list]) -> DataFrame:
    """HPO5: every row of a shortlist with every combination of the values, by exploding literals."""
    for k, v in values.items():
        shortlist = shortlist.withColumn(k, F.explode(F.array(*[F.lit(x) for x in v])))
    return shortlist
