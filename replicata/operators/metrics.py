"""Scores of predictions (MET): one pass of partial aggregates; ranks by distributed running sums.

Rows with a missing real value or prediction (null, NaN) are left out of every score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicata.functions.numbers import no_nan
from replicata.plans.range_scan import running_sums


def _scored(df: DataFrame, real: str, pred: str) -> DataFrame:
    r, p = no_nan(F.col(real).cast("double")), no_nan(F.col(pred).cast("double"))
    return df.withColumns({"_y": r, "_p": p}).filter("_y is not null and _p is not null")


def regression_metrics(df: DataFrame, real: str, pred: str, by: list[str]) -> DataFrame:
    """MET1: ``n, r2, mae, rms, mean, std`` per group; r2 = 1 - residual / total sum of squares, null if all real values are equal."""
    e = F.col("_y") - F.col("_p")
    total = F.count("*") * F.var_pop("_y")
    return _scored(df, real, pred).groupBy(*by).agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(e * e), total)).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rms"), F.avg("_y").alias("mean"), F.stddev_pop("_y").alias("std"))


def kfold_regression(df: DataFrame, real: str, pred: str, fold: str, by: list[str]) -> DataFrame:
    """MET10: mean and population deviation of r2 over folds."""
    return regression_metrics(df, real, pred, [*by, fold]).groupBy(*by).agg(F.count("r2").alias("folds"), F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"))


def kfold_predictions(df: DataFrame, key: str, pred: str) -> DataFrame:
    """MET10: mean and population deviation of a key's predictions over folds; keys without any drop out."""
    return df.withColumn("_p", no_nan(F.col(pred))).filter("_p is not null").groupBy(key).agg(F.avg("_p").alias("pred"), F.stddev_pop("_p").alias("std"))


def confusion_counts(df: DataFrame, real: str, prob: str, by: list[str], cutoff: float = 0.5) -> DataFrame:
    """True and false positives and negatives per group at a cutoff of the probability (inclusive)."""
    y, p = F.col("_y") == 1, F.col("_p") >= cutoff
    return _scored(df, real, prob).groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def classification_metrics(df: DataFrame, real: str, prob: str, by: list[str], cutoff: float = 0.5) -> DataFrame:
    """MET4, 5, 7, 8: precision, recall, npv, accuracy, bal_accuracy, kappa, mcc; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    chance = _ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n)
    out = {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "npv": _ratio(tn, tn + fn),
        "accuracy": _ratio(tp + tn, n),
        "bal_accuracy": (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2,
        "kappa": _ratio(tp + tn - chance, n - chance),
        "mcc": _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }
    return confusion_counts(df, real, prob, by, cutoff).select(*by, *[c.alias(k) for k, c in out.items()])


def _per_class(df: DataFrame, real: str, probs: str, by: list[str]) -> DataFrame:
    """One row per row and class: whether it is the real class (``_is``) and the class's probability (``_prob``); incomplete rows are left out."""
    ok = F.col(real).isNotNull() & F.col(probs).isNotNull() & ~F.exists(probs, lambda p: p.isNull() | F.isnan(p))
    x = df.filter(ok).select(*by, F.col(real).cast("int").alias("_real"), F.posexplode(probs).alias("_class", "_prob"))
    return x.withColumn("_is", (F.col("_real") == F.col("_class")).cast("int"))


def multiclass_metrics(df: DataFrame, real: str, probs: str, by: list[str]) -> DataFrame:
    """MET2 - MET4, MET7 for several classes: macro means over classes of ``roc_auc, avg_precision, precision, recall``, and ``accuracy, bal_accuracy``.

    ``probs`` is an array of probabilities of classes 0, 1, ...; the first largest is the prediction.  Classes that occur neither as real nor as predicted class
    count for nothing; a class without positives or without negatives has no area and none that nothing is predicted as has precision 0.
    """
    from replicata.functions.numbers import argmax_class

    ranks = rank_metrics(_per_class(df, real, probs, by), "_is", "_prob", [*by, "_class"]).groupBy(*by).agg(F.avg("roc_auc").alias("roc_auc"), F.avg("avg_precision").alias("avg_precision"))
    ok = F.col(real).isNotNull() & F.col(probs).isNotNull() & ~F.exists(probs, lambda p: p.isNull() | F.isnan(p))
    pairs = df.filter(ok).groupBy(*by, F.col(real).cast("int").alias("r"), argmax_class(F.col(probs)).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(*by, "n", F.explode(F.array(F.struct(F.col("r").alias("c"), F.lit(1).alias("r1"), F.lit(0).alias("p1")), F.struct(F.col("p").alias("c"), F.lit(0).alias("r1"), F.lit(1).alias("p1")))).alias("x"), (F.col("r") == F.col("p")).alias("hit")).select(*by, "n", "hit", "x.*")
    per = sides.groupBy(*by, "c").agg(F.sum(F.col("n") * F.col("r1")).alias("real"), F.sum(F.col("n") * F.col("p1")).alias("pred"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("r1")).otherwise(0)).alias("tp"))
    macro = per.groupBy(*by).agg(F.avg(_ratio(F.col("tp"), F.col("pred"))).alias("precision"), F.avg(_ratio(F.col("tp"), F.col("real"))).alias("recall"), (F.sum("tp") / F.sum("real")).alias("accuracy"), F.avg(F.when(F.col("real") > 0, F.col("tp") / F.col("real"))).alias("bal_accuracy"))
    if not by:
        return ranks.crossJoin(F.broadcast(macro))  # one row each
    return ranks.join(macro, by)


def score_with(df: DataFrame, real: str, pred: str, by: list[str], prediction_type: str = "regression", n_classes: int = 2, strategy: str = "train_valid_test", fold: str = "fold") -> DataFrame:
    """MET14: the scores that a prediction type, its classes and a split strategy ask for."""
    if prediction_type == "regression":
        return kfold_regression(df, real, pred, fold, by) if strategy == "k_fold_cv" else regression_metrics(df, real, pred, by)
    if prediction_type == "hybrid":
        return hybrid_metrics(df, real, pred, "conc", by)
    if prediction_type != "classification":
        raise ValueError(f"unknown prediction type {prediction_type}")
    return multiclass_metrics(df, real, pred, by) if n_classes > 2 else classification_metrics(df, real, pred, by)


def confusion_matrix(df: DataFrame, real: str, pred: str) -> DataFrame:
    """MET9: ``real, pred, n`` for every pair that occurs."""
    return df.filter(F.col(real).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(real).alias("real"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def score_steps(df: DataFrame, real: str, prob: str, by: list[str]) -> DataFrame:
    """WIN6: per group and distinct score in descending order: ``score, n, pos`` and their running sums ``cum_n, cum_pos``."""
    steps = _scored(df, real, prob).groupBy(*by, (F.col("_p") + 0.0).alias("score")).agg(F.count("*").alias("n"), F.count_if(F.col("_y") == 1).alias("pos"))
    return running_sums(steps, by, [F.col("score").desc()], {"cum_n": "n", "cum_pos": "pos"})


def _with_totals(steps: DataFrame, by: list[str]) -> DataFrame:
    return steps.join(steps.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos")), by)


def rank_metrics(df: DataFrame, real: str, prob: str, by: list[str]) -> DataFrame:
    """MET2, MET3: ``roc_auc`` (ties count half; null with one class only) and ``avg_precision`` (null without positives)."""
    s = score_steps(df, real, prob, by)
    neg_at, neg_above = F.col("n") - F.col("pos"), F.col("cum_n") - F.col("cum_pos")
    # sums over pairs of a positive and a negative: those scored below count 1, those at the same score a half
    above = F.sum(F.col("pos").cast("double") * (neg_above - neg_at * 0.5))
    precision = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    p, n = F.sum("pos").cast("double"), F.sum("n").cast("double")
    return s.groupBy(*by).agg((1 - F.try_divide(above, p * (n - p))).alias("roc_auc"), F.try_divide(precision, p).alias("avg_precision"))


def roc_points(df: DataFrame, real: str, prob: str, by: list[str]) -> DataFrame:
    """MET16: ``score, fpr, tpr`` at every distinct score."""
    t = _with_totals(score_steps(df, real, prob, by), by)
    neg = F.col("all_n") - F.col("all_pos")
    return t.select(*by, "score", F.try_divide(F.col("cum_n") - F.col("cum_pos"), neg).alias("fpr"), F.try_divide(F.col("cum_pos"), F.col("all_pos")).alias("tpr"))


def pr_points(df: DataFrame, real: str, prob: str, by: list[str]) -> DataFrame:
    """MET16: ``score, precision, recall`` at every distinct score."""
    t = _with_totals(score_steps(df, real, prob, by), by)
    return t.select(*by, "score", (F.col("cum_pos") / F.col("cum_n")).alias("precision"), F.try_divide(F.col("cum_pos"), F.col("all_pos")).alias("recall"))


def cross_entropy(df: DataFrame, real: str, prob: str, by: list[str], eps: float = 1e-15) -> DataFrame:
    """MET6: mean negative log-likelihood of the true class, probabilities clipped to [eps, 1 - eps]."""
    p = F.greatest(F.least(F.col("_p"), F.lit(1 - eps)), F.lit(eps))
    return _scored(df, real, prob).groupBy(*by).agg((-F.avg(F.ln(F.when(F.col("_y") == 1, p).otherwise(1 - p)))).alias("cross_entropy"))


def hybrid_metrics(df: DataFrame, real: str, pred: str, conc: str, by: list[str]) -> DataFrame:
    """MET12: r2 of rows without a concentration, of those with one, and their mean; an empty side takes the other's score."""
    m = regression_metrics(df.withColumn("_single", F.col(conc).isNotNull()), real, pred, [*by, "_single"])
    g = m.groupBy(*by).agg(F.max(F.when(~F.col("_single"), F.col("r2"))).alias("a"), F.max(F.when(F.col("_single"), F.col("r2"))).alias("b"))
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    return g.select(*by, a.alias("r2_ki"), b.alias("r2_single"), ((a + b) / 2).alias("score"))


def early_stop(df: DataFrame, scores: str, patience: int, min_gain: float) -> DataFrame:
    """MET15: adds ``best_epoch`` (from 0): training stops when no score has beaten the best by more than ``min_gain`` for ``patience`` epochs.

    ``scores`` is an array of one score per epoch; null for a null or empty array; missing scores never beat anything.
    """
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(-1).alias("at"), F.lit(0).alias("i"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        done = acc["done"] | ((acc["at"] >= 0) & (acc["i"] - acc["at"] > patience))
        better = ~done & F.coalesce(no_nan(x) > acc["best"] + min_gain, F.lit(False))
        return F.struct(F.when(better, x).otherwise(acc["best"]).alias("best"), F.when(better, acc["i"]).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"), done.alias("done"))

    at = F.aggregate(F.transform(scores, lambda x: x.cast("double")), start, step)["at"]
    return df.withColumn("best_epoch", F.when(at >= 0, at))


def class_std(p: Column, trees: int) -> Column:
    """MET17: deviation of a forest's class probability."""
    return F.sqrt(p * (1 - p) / trees)


def hybrid_loss(df: DataFrame, real: str, pred: str, conc: str, poisson: bool = False) -> DataFrame:
    """MOD5: one row ``loss``: squared error of activities and of the bound fraction, or its Poisson form; rows without a value are left out."""
    from replicata.functions.numbers import predict_binding

    s = _scored(df, real, pred)
    c = F.col(conc)
    bound = F.greatest(F.least(predict_binding(F.col("_p"), c), F.lit(1 - 1e-7)), F.lit(1e-7))
    single = (bound - F.col("_y") * F.ln(bound)) if poisson else F.pow(bound - F.col("_y"), F.lit(2.0))
    return s.agg(F.avg(F.when(c.isNull(), F.pow(F.col("_y") - F.col("_p"), F.lit(2.0))).otherwise(single)).alias("loss"))


def wasserstein(df: DataFrame, value: str, subset: str, a: str, b: str) -> DataFrame:
    """DST12: one row ``distance``: area between the two subsets' distribution functions; null if one is empty; missing values are left out."""
    v = no_nan(F.col(value).cast("double")) + 0.0
    points = df.filter(F.col(subset).isin(a, b)).select(v.alias("v"), (F.col(subset) == a).alias("is_a")).filter("v is not null").groupBy("v").agg(F.count_if(F.col("is_a")).alias("na"), F.count_if(~F.col("is_a")).alias("nb"))
    s = running_sums(points.withColumn("g", F.lit(0)), ["g"], [F.col("v")], {"ca": "na", "cb": "nb"})
    from replicata.plans.storage import materialize

    s = materialize(s)
    # The gap to the next value: inside a range partition by a window, across by the partitions' least values (one row each).
    from pyspark.sql import Window

    placed = materialize(s.repartitionByRange("v").withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p").orderBy("v")
    least = placed.groupBy("_p").agg(F.min("v").alias("least")).select("_p", F.lead("least").over(Window.orderBy("_p")).alias("following"))
    gaps = placed.withColumn("next", F.lead("v").over(inside)).join(F.broadcast(least), "_p").withColumn("gap", F.coalesce("next", "following") - F.col("v"))
    total = s.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    return gaps.crossJoin(F.broadcast(total)).agg(F.when((F.max("ta") > 0) & (F.max("tb") > 0), F.coalesce(F.sum(F.abs(F.try_divide("ca", "ta") - F.try_divide("cb", "tb")) * F.col("gap")), F.lit(0.0))).alias("distance"))
