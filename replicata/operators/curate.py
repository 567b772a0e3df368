"""Curation of measurement tables: relations, units, filters, replicates, validation (PRJ, FIL, AGG)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replicata.functions.keys import hash60
from replicata.functions.numbers import all_of, any_of, classify, is_inf, no_nan

# Spellings of relations and what they mean.
RELATIONS = {">": ">", ">=": ">", ">>": ">", "<": "<", "<=": "<", "<<": "<", "=": "=", "==": "=", "~": "=", "@": "="}
# Units and how many of them make one mol per litre.
UNITS = {"pM": 1e12, "nM": 1e9, "uM": 1e6, "µM": 1e6, "mM": 1e3, "M": 1.0}


def standardize_relations(df: DataFrame, relation: str, out: str = "relation", invert: bool = False) -> DataFrame:
    """PRJ1: relations as ``<``, ``>`` or ``=``; quotes and blanks around are dropped, missing and empty mean ``=``, unknown ones drop the row."""
    c = F.trim(F.regexp_replace(F.coalesce(F.col(relation), F.lit("")), "'", ""))
    known = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    r = F.when(c == "", "=").otherwise(F.try_element_at(known, c))
    return df.withColumn(out, F.translate(r, "<>", "><") if invert else r).filter(F.col(out).isNotNull())


def neg_log_response(df: DataFrame, value: str, unit: str, relation: str | None, out: str) -> DataFrame:
    """PRJ2: -log10 of a concentration in mol per litre; rows with non-positive or missing values drop out; ``<`` and ``>`` swap.

    An unknown unit of any row, also of one that drops out, fails the job, as does a missing one.
    """
    per = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    factor = F.try_element_at(per, F.col(unit))
    checked = F.when(factor.isNull(), F.raise_error(F.concat(F.lit("unknown unit: "), F.coalesce(F.col(unit), F.lit("missing"))))).otherwise(factor)
    v = no_nan(F.col(value).cast("double"))
    # The check stands in the filter, so that no optimizer rule can drop it.
    df = df.filter((checked > 0) & (v > 0)).withColumn(out, -F.log10(v / factor))
    return df.withColumn(relation, F.translate(relation, "<>", "><")) if relation else df


def classify_column(df: DataFrame, value: str, thresholds: list[float], out: str, right: bool = True) -> DataFrame:
    """PRJ4: class by thresholds; missing values have no class."""
    return df.withColumn(out, classify(no_nan(F.col(value)), thresholds, right))


def stack_extra_result(df: DataFrame, value: str, extra: str) -> DataFrame:
    """PRJ5: every row once with its value, and rows with an extra result once more with that."""
    rest = [c for c in df.columns if c not in (value, extra)]
    return df.select(*rest, value).unionByName(df.filter(F.col(extra).isNotNull()).select(*rest, F.col(extra).alias(value)))


def make_weights(values: list[str], classification: bool = False) -> tuple[Column, Column]:
    """PRJ7: arrays ``(y, w)``: w is 0 where a response is missing (null, NaN), y there null, or 0 for classes."""
    y = F.array(*[no_nan(F.col(v).cast("double")) for v in values])
    w = F.transform(y, lambda x: F.when(x.isNull(), 0.0).otherwise(1.0))
    return (F.transform(y, lambda x: F.coalesce(x, F.lit(0.0))) if classification else y), w


def filter_values(df: DataFrame, column: str, values: list, keep: bool) -> DataFrame:
    """FIL1: rows with one of ``values`` (``keep``) or with none of them; missing values are none of them."""
    inside = F.coalesce(F.col(column).isin(values), F.lit(False))
    return df.filter(inside if keep else ~inside)


def filter_comments(df: DataFrame, column: str, any_case: list[str], exact: list[str]) -> DataFrame:
    """FIL2: drops rows whose comment contains a listed text; comments that hold ``nan`` or are one blank stay, missing ones too."""
    c = F.col(column)
    bad = any_of([F.contains(F.lower(c), F.lit(x.lower())) for x in any_case] + [F.contains(c, F.lit(x)) for x in exact])
    saved = F.contains(F.lower(c), F.lit("nan")) | (c == " ")
    return df.filter(~F.coalesce(bad & ~saved, F.lit(False)))


def down_select(df: DataFrame, equal: dict[str, object]) -> DataFrame:
    """FIL3: rows that equal all the given values."""
    return df.filter(all_of([F.col(k) == F.lit(v) for k, v in equal.items()]))


def drop_inf(df: DataFrame) -> DataFrame:
    """FIL5: drops rows with an infinite value in any double or float column."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.filter(~any_of([is_inf(F.col(c)) for c in numeric]))


def with_rejects(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """FIL6, FIL7: the rows for which ``keep`` holds, and the complement (where it is false or unknown)."""
    ok = F.coalesce(keep, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def remove_all_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """FIL9: rows whose key occurs once; missing keys equal one another.

    Counts are aggregated before the shuffle and joined, so that no key gathers all its rows in one task.
    """
    once = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n = 1")
    a, b = df.alias("a"), once.alias("b")
    return a.join(b, all_of([F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "left_semi")


def cap_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """FIL11: ``n`` rows by the hash of their key and a seed; the same ones on every run.  Rows are counted in the order of a range sort: none are gathered."""
    from replicata.operators.joins import with_ordinal

    return with_ordinal(df.withColumn("_h", hash60(F.col(key), F.lit(seed))), "_h", key).filter(F.col("ordinal") < n).drop("_h", "ordinal")


# Elements that organic compounds are made of.
ORGANIC = ("H", "B", "C", "N", "O", "F", "Si", "P", "S", "Cl", "Se", "Br", "I")


def exclude_by_elements(df: DataFrame, elements: str, allowed: tuple[str, ...] = ORGANIC) -> DataFrame:
    """FIL8: rows whose array of element symbols (from a structure library's slot) has allowed ones only; missing arrays drop out."""
    return df.filter(F.coalesce(F.forall(elements, lambda e: F.coalesce(e.isin(list(allowed)), F.lit(False))), F.lit(False)))


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """SET7: raises for columns that are not there, naming them in order."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def unknown_units(df: DataFrame, unit: str) -> DataFrame:
    """SET7: the distinct units that have no conversion, ``unit, n``; missing ones too."""
    return df.filter(F.coalesce(~F.col(unit).isin(list(UNITS)), F.lit(True))).groupBy(F.col(unit).alias("unit")).agg(F.count("*").alias("n"))


def to_model_schema(df: DataFrame, names: dict[str, str], back: bool = False) -> DataFrame:
    """PRJ10: columns of the caller under the model's names, or ``back`` again; names that are not there are passed over, clashes raise."""
    pairs = {v: k for k, v in names.items()} if back else names
    out = [pairs.get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise ValueError("two columns would get one name")
    return df.toDF(*out)


def generated_ids(df: DataFrame, order: str, out: str = "compound_id", prefix: str = "compound") -> DataFrame:
    """PRJ12: ids ``compound_000000``, ``compound_000001``, ... in the order of a unique column."""
    from replicata.operators.joins import with_ordinal

    return with_ordinal(df, order).withColumn(out, F.format_string(f"{prefix}_%06d", "ordinal")).drop("ordinal")


# Replicates


def replicate_rmsd(df: DataFrame, key: str, value: str, relation: str) -> DataFrame:
    """AGG2: one row ``rmsd``: deviation of uncensored replicates from their group mean, 1.0 without any replicates."""
    groups = df.filter(F.col(relation).isin("", "=") & F.col(key).isNotNull()).groupBy(key).agg(F.count(value).alias("n"), F.var_pop(value).alias("v")).filter("n > 1")
    return groups.agg(F.coalesce(F.sqrt(F.sum(F.col("n") * F.col("v")) / F.sum("n")), F.lit(1.0)).alias("rmsd"))


def mle_censored_mean(values: np.ndarray, signs: np.ndarray, sigma: float) -> float:
    """Mean of a Gaussian with known deviation from exact (0), left (-1) and right (1) censored values, by bisection on the score.

    With sigma 0 the mean of the exact values.
    """
    exact = values[signs == 0]
    if not sigma > 0:
        return float(np.mean(exact))

    def hazard(z: float) -> float:
        """phi(z) / Phi(z)."""
        if z < -8:
            return -z / (1 - 1 / z**2 + 3 / z**4)
        return math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(-z / math.sqrt(2)))

    def score(m: float) -> float:
        s = float(np.sum(exact - m)) / sigma
        for v, c in zip(values, signs, strict=True):
            if c < 0:
                s -= hazard((v - m) / sigma)
            elif c > 0:
                s += hazard((m - v) / sigma)
        return s

    lo, hi = float(np.min(values)) - sigma, float(np.max(values)) + sigma
    while score(lo) < 0:
        lo -= 2 * (hi - lo)
    while score(hi) > 0:
        hi += 2 * (hi - lo)
    for _ in range(200):
        mid = (lo + hi) / 2
        if hi - lo <= 1e-12 * max(1.0, abs(mid)):
            break
        lo, hi = (mid, hi) if score(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def _mle(values: pd.Series, signs: pd.Series, counts: pd.Series, sigma: pd.Series) -> pd.Series:
    out = [mle_censored_mean(np.repeat(np.asarray(v, float), c), np.repeat(np.asarray(s), c), g) if v is not None else np.nan for v, s, c, g in zip(values, signs, counts, sigma, strict=True)]
    return pd.Series(out)


def censored_means(df: DataFrame, key: str, value: str, relation: str, sigma: DataFrame) -> DataFrame:
    """AGG1b: one row per key: ``key, relation, value``.

    All left-censored: the smallest, ``<``; all right-censored: the largest, ``>``; none censored: the mean, empty relation; mixed: the
    maximum-likelihood mean with the deviation ``rmsd`` of the one-row frame ``sigma``, empty relation.  Missing values and keys drop out.
    Replicates shrink to distinct (value, relation) with counts before any list is made; lists are made of mixed groups only.
    """
    r = F.coalesce(F.col(relation), F.lit(""))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), no_nan(F.col(value).cast("double")).alias("v"), F.when(r == "<", -1).when(r == ">", 1).otherwise(0).alias("s")).filter("v is not null")
    parts = rows.groupBy("key", "v", "s").agg(F.count("*").alias("c"))
    g = parts.groupBy("key").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.min("v").alias("least"), F.max("v").alias("most"), (F.sum(F.when(F.col("s") == 0, F.col("v") * F.col("c"))) / F.sum(F.when(F.col("s") == 0, F.col("c")))).alias("mean"))
    plain = F.when(F.col("hi") == -1, F.col("least")).when(F.col("lo") == 1, F.col("most")).when((F.col("lo") == 0) & (F.col("hi") == 0), F.col("mean"))
    sign = F.when(F.col("hi") == -1, "<").when(F.col("lo") == 1, ">").otherwise("")
    simple = g.filter("lo = hi").select("key", sign.alias("relation"), plain.alias("value"))
    mixed_keys = g.filter("lo <> hi").select("key", "mean")
    from pyspark.sql.types import DoubleType

    mle = F.pandas_udf(_mle, DoubleType())
    lists = parts.join(mixed_keys, "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("v", "s", "c"))).alias("l"))
    fitted = lists.crossJoin(F.broadcast(sigma)).select("key", F.lit("").alias("relation"), mle("l.v", "l.s", "l.c", F.col("rmsd")).alias("value"))
    return simple.unionByName(fitted)


def aggregate_assay(df: DataFrame, key: str, value: str, relation: str, identifier: str, date: str | None = None, active_threshold: float | None = None) -> DataFrame:
    """AGG1: one row per base key: ``compound_id, base_key, relation, value[, date], active``.

    The identifier is the smallest, the date the earliest; rows with a missing or empty key drop out; AGG1a labels a row active if it is not
    left-censored and above the threshold, by default the smallest value among left-censored rows, none: all are active.
    """
    df = df.filter(F.length(F.col(key).cast("string")) > 0)
    means = censored_means(df, key, value, relation, replicate_rmsd(df, key, value, relation))
    ids = df.groupBy(F.col(key).alias("key")).agg(F.min(identifier).alias("compound_id"), *([F.min(date).alias("date")] if date else []))
    out = means.join(ids, "key")
    out = label_actives(out, "value", "relation", active_threshold)
    return out.select("compound_id", F.col("key").alias("base_key"), "relation", "value", *(["date"] if date else []), "active")


def label_actives(df: DataFrame, value: str, relation: str, threshold: float | None = None) -> DataFrame:
    """AGG1a: adds ``active`` (0 or 1); a missing value is not active."""
    if threshold is not None:
        limit = F.lit(threshold)
    else:
        one = df.agg(F.min(F.when(F.col(relation) == "<", F.col(value))).alias("_limit"))
        df, limit = df.crossJoin(F.broadcast(one)), F.col("_limit")
    above = (F.col(relation) != "<") & (limit.isNull() | (F.col(value) > limit))
    return df.withColumn("active", F.coalesce(above, F.lit(False)).cast("int")).drop("_limit")


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles per group (one row without groups), interpolated between neighbours: ``wanted`` maps new names to shares; missing values are left out.

    Values are counted, their counts summed up in order over a range-sorted table, and the values at the ranks picked by a partial aggregate: no group
    and no whole column is gathered.  Groups without values, and an empty table with groups, give no row.
    """
    from replicata.plans.range_scan import running_sums
    from replicata.plans.storage import materialize

    v = no_nan(F.col(value).cast("double")) + 0.0
    counts = df.select(*by, v.alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    steps = materialize(running_sums(counts, by, [F.col("_v")], {"_c": "_n"}))
    total = steps.groupBy(*by).agg(F.max("_c").alias("_t"))
    # The rank of a quantile is (t - 1) q; a value covers ranks _c - _n .. _c - 1.
    if by:
        a, b = steps.alias("a"), total.alias("b")
        both = a.join(b, all_of([F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in by])).select("a.*", "b._t")
    else:
        both = steps.crossJoin(F.broadcast(total))
    rank = {n: (F.col("_t") - 1) * F.lit(float(q)) for n, q in wanted.items()}
    at = both.groupBy(*by).agg(*[F.min(F.when(F.col("_c") > F.floor(r), F.col("_v"))).alias(f"_lo_{n}") for n, r in rank.items()], *[F.min(F.when(F.col("_c") > F.ceil(r), F.col("_v"))).alias(f"_hi_{n}") for n, r in rank.items()], F.max("_t").alias("_t"))
    return at.select(*by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (r - F.floor(r))).alias(n) for n, r in rank.items()])


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """AGG8: per group the most frequent value (``mode``, ties: the smallest) and how often it stands (``mode_n``); missing values are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))).alias("m")
    return counts.groupBy(*by).agg(best).select(*by, F.col("m.v").alias("mode"), (-F.col("m.n")).alias("mode_n"))


def remove_outliers(df: DataFrame, key: str, value: str, max_diff: float) -> DataFrame:
    """AGG4: drops replicates further than ``max_diff`` from their group's median; a group with a missing value loses all rows, single rows stay.

    The median comes from ranks of distinct values (:func:`quantiles`), joined back, a key of very many rows to several tasks; rows with a missing
    key form no group and drop out.
    """
    from replicata.plans.skew import join_per_key
    from replicata.plans.storage import materialize

    rows = df.filter(F.col(key).isNotNull())
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), F.count(no_nan(F.col(value).cast("double"))).alias("_k"))
    whole = rows.select(key, value)
    med = materialize(sizes.join(quantiles(whole, [key], value, {"_m": 0.5}), key, "left").select(key, "_n", F.col("_n").alias("_size"), F.when(F.col("_n") == F.col("_k"), F.col("_m")).alias("_m")))
    ok = (F.col("_size") == 1) | (F.abs(F.col(value) - F.col("_m")) <= max_diff)
    return join_per_key(df, med, [key], "_n").filter(F.coalesce(ok, F.lit(False))).drop("_size", "_m")


def _settle(values: list[float], counts: list[int], tolerance: float, max_std: float) -> tuple[list[bool], float, float]:
    """Values of one group that stay when values far off the mean are removed again and again, their mean and deviation."""
    v, c = np.asarray(values, float), np.asarray(counts)
    keep = np.ones(len(v), dtype=bool)
    while True:
        n = c[keep].sum()
        if not n:
            return keep.tolist(), float("nan"), float("nan")
        mean = float((v[keep] * c[keep]).sum() / n)
        std = float(np.sqrt((c[keep] * (v[keep] - mean) ** 2).sum() / (n - 1))) if n > 1 else float("nan")
        with np.errstate(divide="ignore", invalid="ignore"):
            bad = keep & ((np.abs(v - mean) / mean * 100 > tolerance) | (std > max_std))
        if not bad.any():
            return keep.tolist(), mean, std
        keep &= ~bad


def remove_bad_duplicates(df: DataFrame, key: str, value: str, tolerance: float, max_std: float, long_list: int = 10_000) -> DataFrame:
    """AGG3: one row ``key, mean, std, n`` for every key with values left after repeated removal of those off by more than ``tolerance`` percent.

    The percent deviation keeps the mean's sign, so negative means exceed nothing; a deviation above ``max_std`` removes the whole group.
    Missing keys and values drop out; a single replicate has no std.

    Replicates shrink to distinct values with counts.  A key of at most ``long_list`` different values settles in one go; keys of more, which no task could
    hold, settle together round by round: a round sums moments (from the key's least value, so that nothing cancels), joins them back, a key of
    very many values to several tasks, and writes what stays.
    """
    from replicata.plans.skew import join_per_key
    from replicata.plans.storage import materialize, release

    counts = materialize(df.select(F.col(key).alias("key"), no_nan(F.col(value).cast("double")).alias("v")).dropna().groupBy("key", "v").agg(F.count("*").alias("c")))
    least = counts.groupBy("key").agg(F.min("v").alias("o"), F.count("*").alias("k"))
    least = materialize(least)
    lists = join_per_key(counts, least.filter(F.col("k") <= long_list), ["key"], "k").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("l")).select("key", F.col("l.v").alias("v"), F.col("l.c").alias("c"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, v, c in zip(f["key"], f["v"], f["c"], strict=True):
                keep, mean, std = _settle(v, c, tolerance, max_std)
                if any(keep):
                    rows.append((k, mean, None if math.isnan(std) else std, int(np.asarray(c)[keep].sum())))
            yield pd.DataFrame(rows, columns=["key", "mean", "std", "n"])

    settled = lists.mapInPandas(run, f"key {dict(lists.dtypes)['key']}, mean double, std double, n bigint")
    left = materialize(join_per_key(counts, least.filter(F.col("k") > long_list), ["key"], "k"))
    if left.isEmpty():
        return settled
    d = F.col("v") - F.col("o")
    spread = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0))
    while True:
        sums = left.groupBy("key").agg(F.sum("c").alias("n"), F.sum(d * F.col("c")).alias("s1"), F.sum(d * d * F.col("c")).alias("s2"), F.first("o").alias("_o"), F.count("*").alias("k"))
        stats = materialize(sums.select("key", (F.col("_o") + F.col("s1") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("std"), "n", "k"))
        off = F.when(F.col("mean") == 0, F.col("v") != 0).otherwise(F.abs(F.col("v") - F.col("mean")) / F.col("mean") * 100 > tolerance)
        rated = materialize(join_per_key(left, stats, ["key"], "k").withColumn("bad", off | F.coalesce(F.col("std") > max_std, F.lit(False))))
        moved = rated.filter("bad").select("key").distinct()
        # Keys that lost nothing are done; the others go on with what is left of them.
        done = stats.join(moved, "key", "left_anti").select("key", "mean", "std", "n")
        settled = settled.unionByName(done)
        release(left)
        left = materialize(rated.filter("not bad").join(moved, "key", "left_semi").select("key", "v", "c", "o"))
        if left.isEmpty():
            return settled


# Tables of frequencies, validation


def freq_table(df: DataFrame, column: str, min_freq: int = 1) -> DataFrame:
    """AGG5: ``value, count`` with a row for missing values (null), from ``min_freq`` on."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).filter(F.col("count") >= min_freq)


def labeled_freq_table(df: DataFrame, columns: list[str], min_freq: int = 1) -> DataFrame:
    """AGG6: counts of the first column with the columns that depend on it; a value with two labels fails the job."""
    key, rest = columns[0], columns[1:]
    g = df.groupBy(key).agg(F.count("*").alias("count"), *[F.min(c).alias(c) for c in rest], any_of([~F.min(c).eqNullSafe(F.max(c)) for c in rest]).alias("_two"))
    return g.filter(F.when(F.col("_two"), F.raise_error(F.lit(f"{key} is not many-to-one"))).otherwise(F.col("count") >= min_freq)).drop("_two")


def summarize(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """AGG7, AGG8: rows, values, mean, deviation, quartiles, least and most; per group if ``by`` is given.  Missing groups are a group; a group without values has null quartiles."""
    from replicata.plans.storage import materialize

    c, keys = no_nan(F.col(column).cast("double")), by or []
    agg = [F.count("*").alias("n_rows"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]
    base, q = df.groupBy(*keys).agg(*agg), materialize(quantiles(df, keys, column, {"q25": 0.25, "median": 0.5, "q75": 0.75}))
    a, b = base.alias("a"), q.alias("b")
    same = all_of([F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(F.broadcast(b) if not keys else b, same, "left").select(*[f"a.{k}" for k in keys], "n_rows", "n", "mean", "std", "min", "q25", "median", "q75", "max")


def many_to_one_violations(df: DataFrame, identifier: str, key: str) -> DataFrame:
    """AGG9: identifiers with several keys, missing keys and missing identifiers: ``problem, id, n``."""
    i = F.col(identifier).cast("string").alias("id")
    many = df.filter(F.col(identifier).isNotNull() & F.col(key).isNotNull()).groupBy(i).agg(F.count_distinct(key).alias("n")).filter("n > 1").select(F.lit("several keys").alias("problem"), "id", "n")
    lost = df.filter(F.col(key).isNull()).groupBy(i).agg(F.count("*").alias("n")).select(F.lit("missing key").alias("problem"), "id", "n")
    nobody = df.filter(F.col(identifier).isNull()).agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("missing id").alias("problem"), F.lit(None).cast("string").alias("id"), "n")
    return many.unionByName(lost).unionByName(nobody)


def check_many_to_one(df: DataFrame, identifier: str, key: str) -> None:
    """AGG9: raises for missing keys, missing identifiers or identifiers with several keys, in this order."""
    found = {r.problem: r.n for r in many_to_one_violations(df, identifier, key).groupBy("problem").agg(F.sum("n").alias("n")).collect()}
    for problem in ("missing key", "missing id", "several keys"):
        if problem in found:
            raise ValueError(f"{problem}: {found[problem]}")


def class_freqs(df: DataFrame, column: str, classes: int) -> DataFrame:
    """AGG10: ``class, count`` for 0 .. classes - 1, with zeros."""
    have = df.groupBy(F.col(column).cast("int").alias("class")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    return every.join(have, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("count"))


def class_sets(df: DataFrame, subset: str, column: str, classes: int) -> DataFrame:
    """AGG11: per subset its classes, and whether they are the same as over all rows and inside 0 .. classes - 1."""
    every = df.agg(F.array_sort(F.collect_set(column)).alias("_all"))
    by = df.groupBy(subset).agg(F.array_sort(F.collect_set(column)).alias("classes"), F.coalesce(F.bool_and((F.col(column) >= 0) & (F.col(column) < classes)), F.lit(True)).alias("in_range"))
    return by.crossJoin(F.broadcast(every)).select(subset, "classes", "in_range", (F.col("classes") == F.col("_all")).alias("complete"))


def compact(df: DataFrame, key: str, ordinal: str, identifier: str, weights: list[str]) -> DataFrame:
    """AGG12: one row per key: the first row's identifier by ``ordinal``, and for each task the weight 1 if any row has one."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(identifier, ordinal).alias(identifier), F.min(ordinal).alias(ordinal), *[F.least(F.greatest(F.sum(w), F.lit(0.0)), F.lit(1.0)).alias(w) for w in weights])


def ensemble(df: DataFrame, key: str, pred: str, how: str, std: str | None = None) -> DataFrame:
    """ENS1: one prediction per key over the members' rows; missing predictions are ignored.

    ``how``: mean, median, max, min, or weighted by 1 / ``std`` (a deviation of 0 fails the job).
    """
    p = no_nan(F.col(pred))
    if how == "weighted":
        s = F.when(F.col(std) == 0, F.raise_error(F.lit("a deviation is 0"))).otherwise(F.col(std))
        w = F.when(p.isNotNull(), 1 / s)
        return df.groupBy(key).agg((F.sum(p * w) / F.sum(w)).alias("pred"))
    if how == "median":
        keyed = df.select(key, p.alias("_p"))
        return keyed.select(key).distinct().join(quantiles(keyed, [key], "_p", {"pred": 0.5}), key, "left")
    return df.groupBy(key).agg({"mean": F.avg, "max": F.max, "min": F.min}[how](p).alias("pred"))
