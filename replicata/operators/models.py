"""Models on MLlib: training, prediction, importance by permutation (MOD, FI2)."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def estimator(kind: str, classification: bool, seed: int = 0, **params):
    """MOD1: the estimator of a model type: RF, GBT (also ``xgboost``), linear, NN (a perceptron; classification only, needs ``layers``)."""
    from pyspark.ml import classification as c
    from pyspark.ml import regression as r

    kind = {"xgboost": "GBT"}.get(kind, kind)
    made = {
        ("RF", True): c.RandomForestClassifier,
        ("RF", False): r.RandomForestRegressor,
        ("GBT", True): c.GBTClassifier,
        ("GBT", False): r.GBTRegressor,
        ("linear", True): c.LogisticRegression,
        ("linear", False): r.LinearRegression,
        ("NN", True): c.MultilayerPerceptronClassifier,
    }.get((kind, classification))
    if made is None:
        raise ValueError(f"no {'classifier' if classification else 'regressor'} of type {kind}")
    base = {"featuresCol": "_v", "labelCol": "y"}
    if kind != "linear":
        base["seed"] = seed
    defaults = {"RF": {"numTrees": 20, "maxDepth": 6}, "GBT": {"maxIter": 10, "maxDepth": 4}}.get(kind, {})
    return made(**(base | defaults | params))


def _vectors(df: DataFrame) -> DataFrame:
    return df.filter("features is not null").withColumn("_v", array_to_vector("features"))


def fit(df: DataFrame, kind: str, classification: bool, seed: int = 0, **params) -> Model:
    """MOD2 - MOD4: a model of ``features`` (array of doubles) for ``y``; rows with missing responses or features are left out."""
    rows = _vectors(df.filter("y is not null"))
    if rows.isEmpty():
        raise ValueError("no rows to train on")
    return estimator(kind, classification, seed, **params).fit(rows)


def predict(model: Model, df: DataFrame, key: str) -> DataFrame:
    """MOD7: ``key, pred`` and for classifiers ``prob`` of class 1; rows without features have nulls."""
    out = model.transform(_vectors(df).select(key, "_v"))
    cols = [F.col("prediction").alias("pred")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability")[1].alias("prob"))
    return df.select(key).join(out.select(key, *cols), key, "left")


def tree_std(model: Model, df: DataFrame, key: str) -> DataFrame:
    """MET17: ``key, std``: population deviation of a regression forest's trees; the data are read once, with one column per tree."""
    out = _vectors(df).select(key, "_v")
    names = []
    for i, t in enumerate(model.trees):
        names.append(f"_t{i}")
        out = t.setPredictionCol(names[-1]).transform(out)
    mean = F.aggregate("_p", F.lit(0.0), lambda s, x: s + x) / len(names)
    return out.select(key, F.array(*names).alias("_p")).withColumn("_m", mean).select(key, F.sqrt(F.aggregate("_p", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / len(names)).alias("std"))


def impurity_importance(spark: SparkSession, model: Model) -> DataFrame:
    """FI1: ``feature, importance``: how much a forest's splits by a feature lower the impurity, summing up to 1."""
    v = model.featureImportances.toArray()
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "feature int, importance double")


def train_predict(df: DataFrame, kind: str, classification: bool, seed: int = 0) -> DataFrame:
    """Trains on ``subset = 'train'`` and predicts all rows: ``id, subset, y, pred`` (and ``prob``)."""
    from replicata.plans.storage import materialize

    rows = materialize(df)
    m = fit(rows.filter("subset = 'train'"), kind, classification, seed)
    return rows.select("id", "subset", "y").join(predict(m, rows, "id"), "id")


def kfold_train_predict(df: DataFrame, kind: str, classification: bool, folds: int, seed: int = 0) -> DataFrame:
    """MOD2: one model per ``fold`` trained on the others: ``fold, id, subset, pred`` for validation and test rows."""
    out = None
    for f in range(folds):
        m = fit(df.filter((F.col("subset") != "test") & (F.col("fold") != f)), kind, classification, seed + f)
        part = predict(m, df.filter((F.col("subset") == "test") | (F.col("fold") == f)).select("id", "features"), "id").withColumn("fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def kfold_refit(df: DataFrame, kind: str, classification: bool, folds: int, seed: int = 0, **params) -> tuple[DataFrame, Model]:
    """MOD2: the predictions of one model per fold (:func:`kfold_train_predict`) and the model refitted on all training and validation rows of fold 0."""
    per = kfold_train_predict(df, kind, classification, folds, seed)
    return per, fit(df.filter("subset <> 'test'").dropDuplicates(["id"]), kind, classification, seed, **params)


def predict_selection(documents: DataFrame, load: Callable[[str], Model], df: DataFrame, key: str, identifier: str = "model_uuid", within: float | None = None, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """MOD8: predictions of every model of a registry selection: ``model_uuid, key, pred`` (and ``prob``).  One plan over one reading of the data; a model that
    can't be loaded is skipped.  ``within``: loading stops when the next model would need more than 0.9 of the seconds left (MOD9)."""
    parts, left = [], TimeLimit(within, clock)
    for r in documents.select(identifier).distinct().orderBy(identifier).toLocalIterator():
        if not left.another():
            break
        try:
            model = load(r[0])
        except (OSError, ValueError):
            continue
        parts.append(predict(model, df, key).select(F.lit(r[0]).alias(identifier), "*"))
    if not parts:
        return df.select(F.lit("").alias(identifier), key, F.lit(None).cast("double").alias("pred")).limit(0)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


class TimeLimit:
    """MOD9: whether another step fits: the longest step so far must be at most 0.9 of the time left; without a limit it always does."""

    def __init__(self, seconds: float | None, clock: Callable[[], float] = time.monotonic):
        self.clock, self.end = clock, None if seconds is None else clock() + seconds
        self.last, self.longest = None, 0.0

    def another(self) -> bool:
        now = self.clock()
        if self.last is not None:
            self.longest = max(self.longest, now - self.last)
        self.last = now
        return self.end is None or self.longest <= 0.9 * (self.end - now)


PASS_VALUES = 50_000_000  # numbers of shuffled rows that are written at once (400 MB)


def cluster_importance(model: Model, df: DataFrame, key: str, clusters: DataFrame, repeats: int = 60, seed: int = 0) -> DataFrame:
    """FI3: like :func:`permutation_importance`, but all features of a cluster (``feature, cluster``) are shuffled together: ``feature`` is the cluster."""
    members: dict[int, list[int]] = {}
    for r in clusters.orderBy("cluster", "feature").collect():
        members.setdefault(r.cluster, []).append(r.feature)
    return permutation_importance(model, df, key, list(members.values()), repeats, seed).join(df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(members)], "feature int, cluster int"), "feature").select("cluster", "importance", "std")


def permutation_importance(model: Model, df: DataFrame, key: str, places: list | None = None, repeats: int = 60, seed: int = 0) -> DataFrame:
    """FI2: per feature the mean and deviation over repeats of how much the squared error grows when the feature is shuffled.

    ``places`` None: all places of the arrays; a list among them is shuffled as one, ``feature`` is then the number in ``places``.  A shuffle gives each row the value of the next one in the order of a hash of its key:
    both sides get their place by a range sort.  All features of a repeat are scored in one pass, small tables with several repeats a pass.
    """
    from replicata.operators.joins import with_ordinal
    from replicata.plans.storage import materialize, release, spread

    rows = materialize(df.filter("y is not null and features is not null").select(key, "features", "y"))
    n, width = rows.agg(F.count("*"), F.max(F.size("features"))).first()
    if not n:
        raise ValueError("no rows to score")
    places = list(range(width)) if places is None else places
    error = F.avg(F.pow(F.col("prediction") - F.col("y"), F.lit(2.0))).alias("e")
    base, out = model.transform(_vectors(rows)).agg(error).first().e, []
    step = max(1, PASS_VALUES // (n * max(1, width)))
    for first in range(0, repeats, step):
        reps = F.explode(F.array(*[F.lit(r) for r in range(first, min(first + step, repeats))])).alias("_rep")
        placed = materialize(with_ordinal(rows.select("*", reps).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed), F.col("_rep"))), "_rep", "_h", key).drop("_h"))
        # Each repeat has n ordinals in a row; the last row's next is the first of its repeat.
        start = (F.col("_rep") - first) * n
        shifted = placed.select((start + F.pmod(F.col("ordinal") - start + 1, F.lit(n))).alias("ordinal"), F.col("features").alias("_other"))
        both = materialize(placed.join(shifted, "ordinal"))
        if isinstance(places[0], list):
            sets = F.array(*[F.struct(F.lit(i).alias("_i"), F.array(*[F.lit(p) for p in x]).alias("_set")) for i, x in enumerate(places)])
            each = spread(both).select("_rep", "y", "features", "_other", F.inline(sets))
            swapped = F.transform("features", lambda x, i: F.when(F.array_contains("_set", i), F.get("_other", i)).otherwise(x))
        else:
            each = spread(both).select("_rep", "y", "features", "_other", F.explode(F.array(*[F.lit(i) for i in places])).alias("_i"))
            value = F.array(F.element_at("_other", F.col("_i") + 1))
            swapped = F.concat(F.slice("features", F.lit(1), F.col("_i")), value, F.slice("features", F.col("_i") + 2, F.size("features")))
        scored = model.transform(_vectors(each.select("_rep", "_i", "y", swapped.alias("features")))).groupBy("_rep", "_i").agg(error)
        out += [(r._i, r.e - base) for r in scored.collect()]
        release(placed)
        release(both)
    r = df.sparkSession.createDataFrame(out, "feature int, gain double")
    return r.groupBy("feature").agg(F.avg("gain").alias("importance"), F.stddev_pop("gain").alias("std"))
