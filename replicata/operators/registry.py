"""The model registry: predicates, performance tables, best models, hyperparameter grids, importance of features (FIL12, REG, HPO, FI)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicata.functions.numbers import no_nan

_OPS = {
    "=": lambda c, v: c == F.lit(v),
    "==": lambda c, v: c == F.lit(v),
    "$eq": lambda c, v: c == F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "!=": lambda c, v: c != F.lit(v),
    "$ne": lambda c, v: c != F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "$in": lambda c, v: c.isin(list(v)),
    "nin": lambda c, v: ~c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def _value(df: DataFrame, key: str) -> Column:
    c = F.col(key)
    return no_nan(c) if df.select(c).dtypes[0][1] in ("double", "float") else c


def _predicate(c: Column, want: object) -> Column:
    if isinstance(want, dict):
        return reduce(lambda a, b: a & b, [_OPS[op](c, v) for op, v in want.items()])
    if isinstance(want, (list, tuple)):
        op, v = want
        return _OPS[op](c, v)
    return c == F.lit(want)


def match(df: DataFrame, query: dict[str, object]) -> DataFrame:
    """FIL12: rows that match all predicates; NaN counts as missing, and a missing value matches nothing.

    Values: a scalar, ``[op, v]``, ``{'$op': v}``, or ``['min' | 'max', priority or None]``.  Plain predicates come first, then the extrema by rising
    priority (None last), each among the rows that are left; ties all stay.  An unknown column matches nothing.
    """
    extrema, plain = [], []
    for k, v in query.items():
        if k.split(".")[0] not in df.columns:
            return df.limit(0)
        (extrema if isinstance(v, (list, tuple)) and v[0] in ("min", "max") else plain).append((k, v))
    for k, v in plain:
        df = df.filter(F.coalesce(_predicate(_value(df, k), v), F.lit(False)))
    for k, (how, _) in sorted(extrema, key=lambda x: (x[1][1] is None, x[1][1] or 0)):
        c = _value(df, k)
        best = df.agg((F.max(c) if how == "max" else F.min(c)).alias("_best"))
        df = df.crossJoin(F.broadcast(best)).filter(c == F.col("_best")).drop("_best")
    return df


def perf_table(df: DataFrame, key: str, subset: str, metrics: list[str], subsets: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """REG1, REG2: one row per model with ``best_<subset>_<metric>`` from rows per model and subset; models that miss a subset are left out."""
    agg = [F.max(F.when(F.col(subset) == s, no_nan(F.col(m).cast("double")))).alias(f"best_{s}_{m}") for s in subsets for m in metrics]
    return df.filter(F.col(subset).isin(list(subsets))).groupBy(key).agg(F.count_distinct(subset).alias("_n"), *agg).filter(F.col("_n") == len(subsets)).drop("_n")


def dataset_size(df: DataFrame, strategy: str, train: str, valid: str, test: str) -> Column:
    """REG2: compounds of all subsets; with k-fold the validation rows are training rows too and count once."""
    t, v, s = (F.coalesce(F.col(c), F.lit(0)) for c in (train, valid, test))
    return F.when(F.col(strategy) == "k_fold_cv", t + s).otherwise(t + v + s)


def best_model(df: DataFrame, groups: list[str], metric: str, identifier: str, how: str = "max") -> DataFrame:
    """SRT2: ``groups, identifier, metric`` of the best row per group; ties: the smaller identifier; missing metrics and groups are left out.

    A partial aggregate per group: no group gathers its rows.
    """
    m = no_nan(F.col(metric).cast("double")) + 0.0
    ok = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in groups], m.isNotNull())
    best = F.min(F.struct((-m if how == "max" else m).alias("m"), F.col(identifier).alias("i"))).alias("b")
    out = F.col("b.m") if how == "min" else -F.col("b.m")
    return df.filter(ok).groupBy(*groups).agg(best).select(*groups, F.col("b.i").alias(identifier), out.alias(metric))


def multitask_perf(df: DataFrame, key: str, tasks: str, scores: str, full: str) -> DataFrame:
    """REG4: rows per task of parallel arrays, and one ``full_model`` row with the overall score."""
    per = df.select(F.col(key), F.inline(F.arrays_zip(F.col(tasks).alias("task"), F.col(scores).alias("score"))))
    return per.unionByName(df.select(F.col(key), F.lit("full_model").alias("task"), F.col(full).alias("score")))


def dataset_models(df: DataFrame, dataset: str, model: str) -> DataFrame:
    """REG6: per dataset the models and how many there are; the list is the result."""
    return df.filter(F.col(dataset).isNotNull() & F.col(model).isNotNull()).groupBy(dataset).agg(F.array_sort(F.collect_set(model)).alias("models"), F.count_distinct(model).alias("n_models"))


# Hyperparameters


def linspace(lo: float, hi: float, n: int) -> Column:
    """HPO2: n evenly spaced numbers, both ends included."""
    if n == 1:
        return F.array(F.lit(float(lo)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(lo)) + i * F.lit((hi - lo) / (n - 1)))


def geomspace(lo: float, hi: float, n: int) -> Column:
    """HPO2: n numbers with equal ratios, both ends included."""
    if n == 1:
        return F.array(F.lit(float(lo)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(lo)) * F.pow(F.lit(hi / lo), i / F.lit(float(n - 1))))


def uniform(lo: float, hi: float, n: int, seed: int) -> Column:
    """HPO2: n numbers between lo and hi by a hash of their place and the seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(lo)) + F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.lit(hi - lo))


def grid(spark, values: dict[str, list]) -> DataFrame:
    """HPO1: every combination of the values; a stated product of short lists, made by explode, not a join of tables."""
    df = spark.range(1).select()
    for k, v in values.items():
        df = df.select("*", F.explode(F.array(*[F.lit(x) for x in v])).alias(k))
    return df


def layer_combinations(spark, sizes: list[int], depths: list[int], last: int) -> DataFrame:
    """HPO3: strictly falling layer sizes of the given depths whose final layer is at most ``last``: ``layer_sizes`` as text."""
    combos = [c for n in depths for c in combinations(sorted(set(sizes), reverse=True), n) if c[-1] <= last]
    return spark.createDataFrame([(",".join(map(str, c)),) for c in combos], "layer_sizes string")


def filter_jobs(jobs: DataFrame, done: DataFrame, keys: list[str], params: str, rows: str, factor: float) -> DataFrame:
    """FIL15: jobs that have not run yet and whose parameters times ``factor`` are fewer than their rows; missing values match missing ones."""
    a, b = jobs.alias("a"), done.select(*keys).distinct().alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(b, same, "left_anti").filter(F.coalesce(F.col(params) * factor < F.col(rows), F.lit(False)))


# Features


def feature_stats(df: DataFrame, features: str, label: str | None = None) -> DataFrame:
    """FI1: per place of an array: n, mean, population deviation; with a 0/1 label the t statistic of equal variances between 1 and 0."""
    from replicata.operators.transform import array_moments, merged_moments
    from replicata.plans.storage import materialize

    per = array_moments(df, features, label)
    per = materialize(per) if label else per
    g = merged_moments(per, ["feature"]).select("feature", "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"))
    if label:
        side = lambda v, c: F.max(F.when(F.col("label") == v, F.col(c)))
        s = per.groupBy("feature").agg(*[side(v, c).alias(f"{c}{v}") for c in ("n", "mean", "m2") for v in (0, 1)])
        pooled = F.try_divide(F.col("m20") + F.col("m21"), F.col("n1") + F.col("n0") - 2)
        t = F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n0")))))
        g = g.join(s.select("feature", t.alias("t")), "feature")
    return g


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """WIN5: adds the average rank (from 1) of a column among all rows; missing values have none.

    Distinct values are counted, their counts summed up in order, and the ranks joined back.
    """
    from replicata.plans.range_scan import running_sums

    n = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_g", F.lit(0))
    r = running_sums(n, ["_g"], [F.col("_v")], {"_c": "_n"}).select("_v", (F.col("_c") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(r, F.col(value) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """FI3: one row ``n, rho`` over rows that have both values."""
    both = df.select(no_nan(F.col(a).cast("double")).alias("a"), no_nan(F.col(b).cast("double")).alias("b")).dropna()
    ranked = average_ranks(average_ranks(both, "a", "ra"), "b", "rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))


def spearman_matrix(df: DataFrame, features: str) -> DataFrame:
    """FI3: ``a, b, rho`` for every two places of an array of numbers; constant places are left out, rows with a missing number too.

    Ranks of all places come from one pass of running counts over (place, value); products are summed per task.
    """
    from replicata.plans.range_scan import running_sums
    from replicata.plans.storage import materialize

    rows = materialize(df.filter(F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull() | F.isnan(x))).select(F.monotonically_increasing_id().alias("_r"), F.transform(features, lambda x: x.cast("double") + 0.0).alias("_f")))
    long = rows.select("_r", F.posexplode("_f").alias("i", "x"))
    n = long.groupBy("i", "x").agg(F.count("*").alias("_n"))
    ranks = running_sums(n, ["i"], [F.col("x")], {"_c": "_n"}).select("i", "x", (F.col("_c") - F.col("_n") + (F.col("_n") + 1) / 2).alias("rank"))
    wide = long.join(ranks, ["i", "x"]).groupBy("_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rank"))), lambda s: s["rank"]).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    parts = [np.array(r.m) for r in wide.select("v").mapInArrow(run, "m array<double>").collect()]  # places squared, once per task
    out = []
    if parts:
        m = np.sum(parts, axis=0)
        m = m.reshape(int(round(len(m) ** 0.5)), -1)
        cov = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]
        dev = np.sqrt(np.maximum(np.diag(cov), 0))
        ok = np.flatnonzero(dev > 1e-9)
        out = [(int(i), int(j), float(cov[i, j] / dev[i] / dev[j])) for i in ok for j in ok]
    return df.sparkSession.createDataFrame(out, "a int, b int, rho double")


def ward_clusters(distance: np.ndarray, height: float) -> list[int]:
    """Clusters 1, 2, ... of the Ward linkage of a matrix of distances, cut at a height, numbered by their first member."""
    d, size, members = distance.astype(float) ** 2, {i: 1 for i in range(len(distance))}, {i: [i] for i in range(len(distance))}
    np.fill_diagonal(d, np.inf)
    while len(members) > 1:
        live = sorted(members)
        sub = d[np.ix_(live, live)]
        i, j = np.unravel_index(int(np.argmin(sub)), sub.shape)
        a, b = sorted((live[i], live[j]))
        if d[a, b] > height * height:
            break
        for k in live:
            if k not in (a, b):
                n = size[a] + size[b] + size[k]
                d[a, k] = d[k, a] = ((size[a] + size[k]) * d[a, k] + (size[b] + size[k]) * d[b, k] - size[k] * d[a, b]) / n
        size[a] += size.pop(b)
        members[a] += members.pop(b)
    out = [0] * len(distance)
    for c, m in enumerate(sorted(members.values(), key=min), 1):
        for i in m:
            out[i] = c
    return out


def feature_clusters(rho: DataFrame, height: float) -> DataFrame:
    """FI3: ``feature, cluster``: features whose Spearman correlations are alike: Ward linkage of the distances between rows of the matrix, cut at ``height``.

    The matrix of places alone goes to the driver.
    """
    got = rho.collect()
    ids = sorted({r.a for r in got})
    at = {i: n for n, i in enumerate(ids)}
    m = np.eye(len(ids))
    for r in got:
        m[at[r.a], at[r.b]] = r.rho
    d = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(2))
    return rho.sparkSession.createDataFrame(list(zip(ids, ward_clusters(d, height), strict=True)) if ids else [], "feature int, cluster int")


def quantile_bins(df: DataFrame, value: str, bins: int, out: str) -> DataFrame:
    """WIN7: bin 0 .. bins - 1 by quantile edges, right-closed; missing values have no bin."""
    c = no_nan(F.col(value).cast("double"))
    from replicata.operators.curate import quantiles

    edges = quantiles(df.select(c.alias("_v")), [], "_v", {f"_q{i}": i / bins for i in range(1, bins)}).select(F.array(*[f"_q{i}" for i in range(1, bins)]).alias("_e"))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(c.isNotNull(), F.size(F.filter("_e", lambda e: e < c)))).drop("_e")


def stratified_top_n(df: DataFrame, source: str, order: list[Column], fraction: float, identifier: str) -> DataFrame:
    """SRT4: the top rows of each source, round-half-even(fraction x rows) of them; missing sources are left out.

    Positions are running counts over a range-sorted table, so a source of any size spreads over tasks.
    """
    from replicata.plans.range_scan import running_sums

    d = df.filter(F.col(source).isNotNull()).withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_sums(d, [source], [*order, F.col(identifier)], {"position": "_one"})
    quota = d.groupBy(source).agg(F.bround(F.count("*") * F.lit(fraction), 0).alias("_q"))
    return placed.join(quota, source).filter(F.col("position") <= F.col("_q")).drop("_q", "_one")
