"""Queries of scores, transformations, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from replicata.operators import distance, metrics, transform
from replicata.queries.curation import SPARSE, r6, sparse_tasks
from replicata.queries.registry import Registry
from replicata.sources.tables import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

# Scores


def _regression(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500 + F.col("l_tax") * 10000).alias("pred"), F.col("l_returnflag").alias("task"), (F.col("l_orderkey") % 5).alias("fold"), F.when(F.col("l_linenumber") == 1, 100.0).alias("conc"))


_REG = "h AS (SELECT l_partkey AS id, l_extendedprice AS y, l_quantity * 1500 + l_tax * 10000 AS pred, l_returnflag AS task, l_orderkey % 5 AS fold, CASE WHEN l_linenumber = 1 THEN 100.0 END AS conc FROM lineitem)"


def _binary(spark, d):
    return table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), ((F.col("o_orderkey") * 7 % 100) / 100).alias("p"), F.col("o_orderpriority").alias("task"))


_BIN = "b AS (SELECT (o_orderstatus = 'F')::INT AS y, (o_orderkey * 7 % 100) / 100.0e0 AS p, o_orderpriority AS task FROM orders), c AS (SELECT task, count(*) FILTER (WHERE y = 1 AND p >= 0.5)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5)::DOUBLE AS fp, count(*) FILTER (WHERE y = 0 AND p < 0.5)::DOUBLE AS tn, count(*) FILTER (WHERE y = 1 AND p < 0.5)::DOUBLE AS fn FROM b GROUP BY task)"
_STEPS = _BIN + ", s AS (SELECT task, p AS score, count(*) AS n, sum(y) AS pos FROM b GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos, sum(n) OVER (PARTITION BY task) AS all_n, sum(pos) OVER (PARTITION BY task) AS all_pos FROM s WINDOW w AS (PARTITION BY task ORDER BY score DESC))"
_R2 = "1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y))"


@R.query(f"WITH {_REG} SELECT task, count(*) AS n, round({_R2}, 6) AS r2, round(avg(abs(y - pred)), 4) AS mae, round(sqrt(avg((y - pred) * (y - pred))), 4) AS rms FROM h GROUP BY 1")
def regression_metrics(spark, d):
    m = metrics.regression_metrics(_regression(spark, d), "y", "pred", ["task"])
    return m.select("task", "n", r6(F.col("r2"), "r2"), F.round("mae", 4).alias("mae"), F.round("rms", 4).alias("rms"))


@R.query(f"WITH {_REG}, f AS (SELECT task, fold, {_R2} AS r2 FROM h GROUP BY 1, 2) SELECT task, count(*) AS folds, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std FROM f GROUP BY 1")
def kfold_metrics(spark, d):
    k = metrics.kfold_regression(_regression(spark, d), "y", "pred", "fold", ["task"])
    return k.select("task", "folds", r6(F.col("r2_mean"), "r2_mean"), r6(F.col("r2_std"), "r2_std"))


@R.query(f"WITH {_REG} SELECT id, round(avg(pred), 6) AS pred, round(stddev_pop(pred), 6) AS std FROM h GROUP BY 1")
def kfold_pred_mean(spark, d):
    return metrics.kfold_predictions(_regression(spark, d), "id", "pred").select("id", r6(F.col("pred"), "pred"), r6(F.col("std"), "std"))


@R.query(f"WITH {_REG}, f AS (SELECT task, conc IS NOT NULL AS single, {_R2} AS r2 FROM h GROUP BY 1, 2) SELECT task, round(max(r2) FILTER (WHERE NOT single), 6) AS r2_ki, round(max(r2) FILTER (WHERE single), 6) AS r2_single, round(avg(r2), 6) AS score FROM f GROUP BY 1")
def hybrid_metrics(spark, d):
    h = metrics.hybrid_metrics(_regression(spark, d), "y", "pred", "conc", ["task"])
    return h.select("task", *[r6(F.col(c), c) for c in ("r2_ki", "r2_single", "score")])


@R.query(f"WITH {_STEPS} SELECT task, round(1 - sum(pos * ((cum_n - cum_pos) - 0.5e0 * (n - pos))) / (max(all_pos) * (max(all_n) - max(all_pos)))::DOUBLE, 6) AS roc_auc FROM k GROUP BY 1")
def roc_auc(spark, d):
    return metrics.rank_metrics(_binary(spark, d), "y", "p", ["task"]).select("task", r6(F.col("roc_auc"), "roc_auc"))


@R.query(f"WITH {_STEPS} SELECT task, round(sum(pos * cum_pos::DOUBLE / cum_n) / max(all_pos), 6) AS avg_precision FROM k GROUP BY 1")
def avg_precision(spark, d):
    return metrics.rank_metrics(_binary(spark, d), "y", "p", ["task"]).select("task", r6(F.col("avg_precision"), "avg_precision"))


@R.query(f"WITH {_STEPS} SELECT task, score, round((cum_n - cum_pos)::DOUBLE / (all_n - all_pos), 6) AS fpr, round(cum_pos::DOUBLE / all_pos, 6) AS tpr FROM k")
def roc_points(spark, d):
    return metrics.roc_points(_binary(spark, d), "y", "p", ["task"]).select("task", "score", r6(F.col("fpr"), "fpr"), r6(F.col("tpr"), "tpr"))


@R.query(f"WITH {_STEPS} SELECT task, score, round(cum_pos::DOUBLE / cum_n, 6) AS precision, round(cum_pos::DOUBLE / all_pos, 6) AS recall FROM k")
def pr_points(spark, d):
    return metrics.pr_points(_binary(spark, d), "y", "p", ["task"]).select("task", "score", r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"))


_CLASS_SQL = {
    "precision_recall": "round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall",
    "npv": "round(tn / (tn + fn), 6) AS npv",
    "accuracy": "round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy",
    "bal_accuracy": "round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS bal_accuracy",
    "kappa": "round(((tp + tn) - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (tp + fp + tn + fn)) / ((tp + fp + tn + fn) - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (tp + fp + tn + fn)), 6) AS kappa",
    "mcc": "round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc",
}
for _name, _expr in _CLASS_SQL.items():

    @R.query(f"WITH {_BIN} SELECT task, {_expr} FROM c", name=_name)
    def _classification(spark, d, names=tuple(_name.split("_") if _name == "precision_recall" else [_name])):
        m = metrics.classification_metrics(_binary(spark, d), "y", "p", ["task"])
        return m.select("task", *[r6(F.col(n), n) for n in names])


@R.query(f"WITH {_BIN} SELECT task, round(-avg(ln(CASE WHEN y = 1 THEN greatest(least(p, 1 - 1e-15), 1e-15) ELSE 1 - greatest(least(p, 1 - 1e-15), 1e-15) END)), 6) AS cross_entropy FROM b GROUP BY 1")
def cross_entropy(spark, d):
    return metrics.cross_entropy(_binary(spark, d), "y", "p", ["task"]).select("task", r6(F.col("cross_entropy"), "cross_entropy"))


@R.query("SELECT label AS real, ((list_position(embedding, list_max(embedding)) - 1) % 10)::INT AS pred, count(*) AS n FROM embeddings GROUP BY 1, 2")
def confusion_matrix(spark, d):
    from replicata.functions.numbers import argmax_class

    return metrics.confusion_matrix(table(spark, d, "embeddings").withColumn("p", argmax_class(F.col("embedding")) % 10), "label", "p")


@R.query()
def early_stop_epoch(spark, d):
    """The 64 numbers of a vector as scores of as many epochs."""
    return metrics.early_stop(table(spark, d, "embeddings"), "embedding", patience=10, min_gain=0.01).select("vec_id", "best_epoch")


@R.query("SELECT o_orderkey, round(sqrt(p * (1 - p) / 100), 9) AS std FROM (SELECT o_orderkey, (o_orderkey * 7 % 100) / 100.0e0 AS p FROM orders)")
def rf_class_std(spark, d):
    p = (F.col("o_orderkey") * 7 % 100) / 100
    return table(spark, d, "orders").select("o_orderkey", F.round(metrics.class_std(p, 100), 9).alias("std"))


_HYB = "x AS (SELECT value / 50 AS y, (event_id % 90) / 10.0e0 AS pred, CASE WHEN event_type = 'click' THEN 100.0e0 END AS conc FROM events)"


@R.query(f"WITH {_HYB}, z AS (SELECT y, pred, conc, greatest(least(1.0e0 / (1.0e0 + pow(10.0e0, 9.0e0 - pred) / conc), 1 - 1e-7), 1e-7) AS q FROM x) SELECT round(avg(CASE WHEN conc IS NULL THEN (y - pred) * (y - pred) ELSE (q - y) * (q - y) END), 6) AS loss FROM z")
def hybrid_loss(spark, d):
    e = table(spark, d, "events").select((F.col("value") / 50).alias("y"), ((F.col("event_id") % 90) / 10).alias("pred"), F.when(F.col("event_type") == "click", 100.0).alias("conc"))
    return metrics.hybrid_loss(e, "y", "pred", "conc").select(r6(F.col("loss"), "loss"))


@R.query("""WITH u AS (SELECT l_extendedprice AS v, 1.0e0 / count(*) OVER () AS wa, 0.0e0 AS wb FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_extendedprice, 0.0e0, 1.0e0 / count(*) OVER () FROM lineitem WHERE l_returnflag = 'R'),
g AS (SELECT v, sum(wa) AS wa, sum(wb) AS wb FROM u GROUP BY v), c AS (SELECT v, sum(wa) OVER w AS fa, sum(wb) OVER w AS fb, lead(v) OVER w AS nv FROM g WINDOW w AS (ORDER BY v))
SELECT round(sum(abs(fa - fb) * (nv - v)), 4) AS distance FROM c""")
def wasserstein(spark, d):
    return metrics.wasserstein(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R").select(F.round("distance", 4).alias("distance"))


# Transformations

_YS = ", ".join(f"coalesce(avg({t}), 0) AS mean_{t}, CASE WHEN count({t}) >= 2 THEN stddev_pop({t}) ELSE 0 END AS std_{t}" for t in ("ta", "tn", "tr"))
_TASKS = ["ta", "tn", "tr"]


@R.query(f"WITH {SPARSE}, s AS (SELECT {_YS} FROM sparse) SELECT " + ", ".join(f"round({m}_{t}, 6) AS {m}_{t}" for t in _TASKS for m in ("mean", "std")) + " FROM s")
def y_stats(spark, d):
    s = transform.y_stats(sparse_tasks(spark, d), _TASKS)
    return s.select(*[r6(F.col(c), c) for c in s.columns])


@R.query(f"WITH {SPARSE}, s AS (SELECT {_YS} FROM sparse) SELECT key, " + ", ".join(f"round(coalesce(({t} - mean_{t}) / (CASE WHEN std_{t} = 0 THEN 1 ELSE std_{t} END), 0), 6) AS {t}" for t in _TASKS) + " FROM sparse, s")
def normalize_y(spark, d):
    n = transform.normalize_y(sparse_tasks(spark, d), _TASKS)
    return n.select("key", *[r6(F.col(t), t) for t in _TASKS])


@R.query(f"WITH {SPARSE}, s AS (SELECT {_YS} FROM sparse) SELECT key, " + ", ".join(f"round(coalesce({t}, mean_{t}), 6) AS {t}" for t in _TASKS) + " FROM sparse, s")
def untransform_y(spark, d):
    from replicata.plans.storage import materialize

    y = sparse_tasks(spark, d)
    s = materialize(transform.y_stats(y, _TASKS))
    back = transform.untransform_y(transform.normalize_y(y, _TASKS, s), _TASKS, s)
    return back.select("key", *[r6(F.col(t), t) for t in _TASKS])


@R.query("""WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM l GROUP BY i)
SELECT vec_id, i::INT AS i, round((x - m) / s, 6) AS x FROM l JOIN s USING (i)""")
def normalize_x(spark, d):
    return transform.normalize_x(table(spark, d, "embeddings"), "embedding").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@R.query(f"WITH x AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 100.0 END AS conc, CASE WHEN event_type = 'click' THEN value / 500 ELSE value / 50 END AS v FROM events), s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM x WHERE conc IS NULL) SELECT event_id, round(CASE WHEN conc IS NULL THEN (v - m) / s ELSE greatest(least(v, 0.999), 0.001) END, 6) AS v FROM x, s")
def normalize_hybrid(spark, d):
    click = F.col("event_type") == "click"
    e = table(spark, d, "events").select("event_id", F.when(click, 100.0).alias("conc"), F.when(click, F.col("value") / 500).otherwise(F.col("value") / 50).alias("v"))
    return transform.normalize_hybrid(e, "v", "conc").select("event_id", r6(F.col("v"), "v"))


@R.query("SELECT rec_id, round(CASE WHEN active IS NULL THEN 0 ELSE (count(active) OVER ())::DOUBLE / count(*) OVER (PARTITION BY active) END, 6) AS weight FROM htr3a_dtc_smiles_curated")
def balancing_weights(spark, d):
    return transform.balancing_weights(table(spark, d, "htr3a_dtc_smiles_curated"), "active").select("rec_id", r6(F.col("weight"), "weight"))


@R.query(f"WITH {SPARSE} SELECT f.i::INT AS fold, " + ", ".join(f"round(avg({t}), 6) AS mean_{t}, round(stddev_pop({t}), 6) AS std_{t}" for t in _TASKS) + " FROM range(3) f(i) JOIN sparse ON key % 3 <> f.i GROUP BY 1")
def fold_stats(spark, d):
    s = transform.fold_stats(sparse_tasks(spark, d).withColumn("f", (F.col("key") % 3).cast("int")), _TASKS, "f", 3)
    return s.select("fold", *[r6(F.col(c), c) for c in s.columns if c != "fold"])


@R.query(f"WITH {SPARSE} SELECT key, " + ", ".join(f"round(coalesce({t}, avg({t}) OVER ()), 6) AS {t}" for t in _TASKS) + " FROM sparse")
def impute_mean(spark, d):
    return transform.impute_mean(sparse_tasks(spark, d), _TASKS).select("key", *[r6(F.col(t), t) for t in _TASKS])


@R.query()
def undersample(spark, d):
    return transform.undersample(table(spark, d, "htr3a_dtc_smiles_curated").select("rec_id", "active"), "rec_id", "active", 1, 500, seed=17)


@R.query()
def smote(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return transform.smote(e, "vec_id", "embedding", "label", 3, per_row=2, k=5, seed=17)


# Distances: every 20th vector as query against all


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _queries(spark, d):
    return _vectors(spark, d).filter("id % 20 = 0")


_VEC = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE id % 20 = 0)"
_EUC = _VEC + ", p AS (SELECT q.id AS query_id, e.id AS id, list_distance(q.v, e.v) AS distance FROM q, e)"
_RANKED = _EUC + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p WHERE query_id <> id)"


@R.query(f"WITH {_EUC} SELECT query_id, id, round(distance, 6) AS distance FROM p")
def euclid_pairs(spark, d):
    return distance.pair_distances(_queries(spark, d), _vectors(spark, d), "euclidean").withColumn("distance", F.round("distance", 6))


@R.query(f"WITH {_VEC} SELECT q.id AS query_id, e.id AS id, abs(round(list_cosine_distance(q.v, e.v), 6)) AS distance FROM q, e")
def cosine_pairs(spark, d):
    return distance.pair_distances(_queries(spark, d), _vectors(spark, d), "cosine").withColumn("distance", F.abs(F.round("distance", 6)))


def _bits(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.filter(F.transform("embedding", lambda x, i: F.when(x > 0.1, i)), lambda i: i.isNotNull()).alias("bits"))


_BITS = "f AS (SELECT vec_id AS id, list_filter(list_transform(embedding, lambda x, i: CASE WHEN x > 0.1::FLOAT THEN i - 1 END), lambda i: i IS NOT NULL) AS b FROM embeddings), tp AS (SELECT q.id AS query_id, f.id AS id, CASE WHEN len(q.b) + len(f.b) = 0 THEN 0 ELSE 1 - len(list_intersect(q.b, f.b))::DOUBLE / (len(q.b) + len(f.b) - len(list_intersect(q.b, f.b))) END AS distance FROM f q, f WHERE q.id % 20 = 0)"


@R.query(f"WITH {_BITS} SELECT query_id, id, round(distance, 6) AS distance FROM tp")
def tanimoto_pairs(spark, d):
    f = _bits(spark, d)
    return distance.tanimoto_pairs(f.filter("id % 20 = 0"), f, 64).withColumn("distance", F.round("distance", 6))


@R.query(f"WITH {_RANKED} SELECT query_id, id, rank::INT AS rank FROM k WHERE rank <= 5")
def knn_edges(spark, d):
    return distance.nearest(_queries(spark, d), _vectors(spark, d), 5, "euclidean", skip_self=True).select("query_id", "id", "rank")


for _name, _kind, _n, _sql in [
    ("nn_nearest", "nearest", 1, f"WITH {_RANKED} SELECT query_id, round(distance, 6) AS distance FROM k WHERE rank = 1"),
    ("nn_nth", "nth_nearest", 3, f"WITH {_RANKED} SELECT query_id, round(distance, 6) AS distance FROM k WHERE rank = 3"),
    ("nn_avg_n", "avg_n_nearest", 5, f"WITH {_RANKED} SELECT query_id, round(avg(distance), 6) AS distance FROM k WHERE rank <= 5 GROUP BY 1"),
    ("nn_farthest", "farthest", 1, f"WITH {_EUC} SELECT query_id, round(max(distance), 6) AS distance FROM p GROUP BY 1"),
    ("nn_avg", "avg", 1, f"WITH {_EUC} SELECT query_id, round(avg(distance), 6) AS distance FROM p GROUP BY 1"),
]:

    @R.query(_sql, name=_name)
    def _summary(spark, d, kind=_kind, n=_n):
        return distance.summarize_distances(_queries(spark, d), _vectors(spark, d), kind, "euclidean", n).select("query_id", F.round("distance", 6).alias("distance"))


@R.query(f"WITH {_EUC} SELECT query_id, round(min(distance), 6) AS distance FROM p WHERE id % 20 <> 0 GROUP BY 1")
def subset_nn(spark, d):
    train = _vectors(spark, d).filter("id % 20 <> 0")
    return distance.summarize_distances(_queries(spark, d), train, "nearest", "euclidean", within=False).select("query_id", F.round("distance", 6).alias("distance"))


@R.query(f"WITH {_EUC} SELECT query_id, count(*) AS n FROM p WHERE distance <= 1.3 GROUP BY 1")
def neighbour_counts(spark, d):
    return distance.neighbour_counts(_queries(spark, d), _vectors(spark, d), "euclidean", 1.3)


@R.query()
def butina_clusters(spark, d):
    return distance.butina(_vectors(spark, d), "euclidean", 1.25)


_AD = _VEC + """, tr AS (SELECT * FROM e WHERE id % 20 <> 0), own AS (SELECT a.id, b.id AS nb, list_distance(a.v, b.v) AS dist FROM tr a, tr b),
ownk AS (SELECT id, sum(dist) / 3 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS r FROM own) WHERE r <= 4 GROUP BY id),
qk AS (SELECT query_id, id, dist FROM (SELECT q.id AS query_id, tr.id, list_distance(q.v, tr.v) AS dist, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, tr.v), tr.id) AS r FROM q, tr) WHERE r <= 3)"""


@R.query(f"WITH {_AD} SELECT query_id, round(greatest((avg(qk.dist) - (SELECT avg(dist) FROM ownk)) / (SELECT stddev_pop(dist) FROM ownk), 1e-6), 6) AS ad_index FROM qk GROUP BY 1")
def ad_zscore(spark, d):
    train = _vectors(spark, d).filter("id % 20 <> 0")
    return distance.ad_zscore(_queries(spark, d), train, 3).select("query_id", r6(F.col("ad_index"), "ad_index"))


@R.query(f"WITH {_AD} SELECT query_id, round(avg(qk.dist) / avg(ownk.dist), 6) AS ad_index FROM qk JOIN ownk USING (id) GROUP BY 1")
def ad_local_density(spark, d):
    train = _vectors(spark, d).filter("id % 20 <> 0")
    return distance.ad_local_density(_queries(spark, d), train, 3).select("query_id", r6(F.col("ad_index"), "ad_index"))


@R.query(f"WITH {_AD}, ids AS (SELECT query_id, list(id ORDER BY dist, id) AS neighbours FROM qk GROUP BY 1) SELECT query_id, round(greatest((avg(qk.dist) - (SELECT avg(dist) FROM ownk)) / (SELECT stddev_pop(dist) FROM ownk), 1e-6), 6) AS ad_index, any_value(array_to_string(neighbours, ',')) AS neighbours FROM qk JOIN ids USING (query_id) GROUP BY 1")
def ad_driver(spark, d):
    a = distance.applicability(_queries(spark, d), _vectors(spark, d).filter("id % 20 <> 0"), 3)
    return a.select("query_id", r6(F.col("ad_index"), "ad_index"), F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@R.query(f"WITH {_RANKED}, m AS (SELECT query_id, avg(distance) AS a FROM p GROUP BY 1) SELECT query_id AS id, round(min(distance), 6) AS nearest, round(avg(distance), 6) AS mean_k, round(any_value(a), 6) AS mean_all FROM k JOIN m USING (query_id) WHERE rank <= 5 GROUP BY 1")
def diversity_report(spark, d):
    v = distance.diversity(_vectors(spark, d), "euclidean", 5)
    return v.select("id", *[r6(F.col(c), c) for c in ("nearest", "mean_k", "mean_all")])


_MULTI = """m AS (SELECT vec_id, label % 3 AS y, label % 2 AS task, list_transform([1, 2, 3], lambda i: exp(2.0e0 * embedding[i]::DOUBLE)) AS e FROM embeddings),
pr AS (SELECT *, list_transform(e, lambda x: x / (e[1] + e[2] + e[3])) AS p FROM m),
cl AS (SELECT task, vec_id, c.i AS c, (y = c.i)::INT AS y, p[c.i + 1] AS s FROM pr, range(3) c(i)),
rk AS (SELECT *, rank() OVER (PARTITION BY task, c ORDER BY s) + (count(*) OVER (PARTITION BY task, c, s) - 1) / 2.0e0 AS r FROM cl),
auc AS (SELECT task, c, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS a FROM rk GROUP BY 1, 2),
st AS (SELECT task, c, s, count(*) AS n, sum(y) AS pos FROM cl GROUP BY 1, 2, 3), cu AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM st WINDOW w AS (PARTITION BY task, c ORDER BY s DESC)),
ap AS (SELECT task, c, sum(pos * cp / cn::DOUBLE) / sum(pos) AS a FROM cu GROUP BY 1, 2),
bp AS (SELECT task, y, list_position(p, list_max(p)) - 1 AS h FROM pr),
pc AS (SELECT task, c.i AS c, count(*) FILTER (WHERE y = c.i AND h = c.i)::DOUBLE AS tp, count(*) FILTER (WHERE h = c.i) AS pred, count(*) FILTER (WHERE y = c.i) AS real FROM bp, range(3) c(i) GROUP BY 1, 2)"""


@R.query(f"""WITH {_MULTI} SELECT task, round((SELECT avg(a) FROM auc WHERE auc.task = pc.task), 6) AS roc_auc, round((SELECT avg(a) FROM ap WHERE ap.task = pc.task), 6) AS avg_precision,
 round(avg(CASE WHEN pred = 0 THEN 0 ELSE tp / pred END), 6) AS precision, round(avg(CASE WHEN real = 0 THEN 0 ELSE tp / real END), 6) AS recall, round(sum(tp) / sum(real), 6) AS accuracy, round(avg(tp / real), 6) AS bal_accuracy FROM pc GROUP BY task""")
def multiclass_metrics(spark, d):
    e = table(spark, d, "embeddings")
    x = [F.exp(2.0 * F.col("embedding")[i].cast("double")) for i in range(3)]
    m = e.select((F.col("label") % 3).alias("y"), (F.col("label") % 2).alias("task"), F.array(*[v / (x[0] + x[1] + x[2]) for v in x]).alias("p"))
    return metrics.multiclass_metrics(m, "y", "p", ["task"]).select("task", *[r6(F.col(c), c) for c in ("roc_auc", "avg_precision", "precision", "recall", "accuracy", "bal_accuracy")])
