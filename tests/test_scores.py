import math

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from replicata.operators import distance, joins, metrics, registry, splits, transform
from replicata.plans.range_scan import running_sums

NAN = float("nan")


def test_running_sums(spark):
    rng = np.random.default_rng(0)
    data = [("hot" if i % 3 else None, i, int(x)) for i, x in enumerate(rng.integers(0, 9, 500))]
    got = running_sums(spark.createDataFrame(data, "g string, i int, x int"), ["g"], [F.col("i").desc()], {"s": "x"}).collect()
    want = {i: sum(y for h, j, y in data if h == g and j >= i) for g, i, _ in data}
    assert {r.i: r.s for r in got} == want


def test_regression(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 3.0, 3.0), ("b", 1.0, 2.0), ("b", 3.0, 2.0), ("b", NAN, 1.0), ("c", 5.0, 5.0)], "t string, y double, p double")
    got = {r.t: r for r in metrics.regression_metrics(df, "y", "p", ["t"]).collect()}
    assert got["a"].r2 == 1.0 and got["b"].r2 == 0.0 and got["b"].n == 2 and got["c"].r2 is None
    assert got["b"].mae == 1.0 and got["b"].rms == 1.0


def test_rank_scores_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [("t", int(rng.random() < 0.4), float(rng.integers(0, 8)) / 8) for _ in range(200)] + [("one", 1, 0.3), ("one", 1, 0.4)]
    got = {r.t: r for r in metrics.rank_metrics(spark.createDataFrame(data, "t string, y int, p double"), "y", "p", ["t"]).collect()}
    pos, neg = [p for t, y, p in data if t == "t" and y], [p for t, y, p in data if t == "t" and not y]
    assert abs(got["t"].roc_auc - np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])) < 1e-12
    ap = sum(pos.count(s) * sum(p >= s for p in pos) / sum(p >= s for p in pos + neg) for s in set(pos)) / len(pos)
    assert abs(got["t"].avg_precision - ap) < 1e-12
    assert got["one"].roc_auc is None


def test_classification_without_positives(spark):
    r = metrics.classification_metrics(spark.createDataFrame([(0, 0.1), (0, 0.9)], "y int, p double"), "y", "p", []).first()
    assert (r.precision, r.recall, r.npv, r.mcc) == (0.0, 0.0, 1.0, 0.0)


def test_hybrid_and_stop(spark):
    h = spark.createDataFrame([("a", 1.0, 1.0, None), ("a", 2.0, 2.0, None)], "t string, y double, p double, c double")
    assert rows(metrics.hybrid_metrics(h, "y", "p", "c", ["t"])) == [("a", 1.0, 1.0, 1.0)]
    s = spark.createDataFrame([(1, [1.0, 2.0, 2.05, 2.0, 9.0]), (2, []), (3, None), (4, [NAN, 1.0])], "id int, s array<double>")
    assert {r.id: r.best_epoch for r in metrics.early_stop(s, "s", 1, 0.1).collect()} == {1: 1, 2: None, 3: None, 4: 1}


def test_wasserstein(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", float(i + 2)) for i in range(5)] + [("a", NAN)], "s string, v double")
    assert abs(metrics.wasserstein(df, "v", "s", "a", "b").first().distance - 2.0) < 1e-12
    assert metrics.wasserstein(df, "v", "s", "a", "z").first().distance is None


def test_normalization(spark):
    df = spark.createDataFrame([(1, 1.0, NAN), (2, 3.0, 4.0), (3, 5.0, 6.0)], "id int, a double, b double")
    s = transform.y_stats(df, ["a", "b"]).first()
    assert (s.mean_a, s.mean_b, s.std_b) == (3.0, 5.0, 1.0) and abs(s.std_a - 1.632993) < 1e-6
    got = [[round(x, 6) for x in r] for r in sorted(transform.normalize_y(df, ["a", "b"]).collect())]
    assert got == [[1, -1.224745, 0.0], [2, 0.0, -1.0], [3, 1.224745, 1.0]]
    none = spark.createDataFrame([(1, None, None)], "id int, a double, b double")
    assert tuple(transform.y_stats(none, ["a", "b"]).first()) == (0.0, 0.0, 0.0, 0.0)
    x = spark.createDataFrame([([1.0, 2.0, NAN],), ([3.0, 2.0, 1.0],)], "v array<double>")
    assert [r.v for r in transform.normalize_x(x, "v").collect()] == [[-1.0, 0.0, 0.0], [1.0, 0.0, 0.0]]


def test_resampling(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], int(i < 5)) for i in range(40)], "id bigint, v array<double>, y int")
    u = transform.undersample(df, "id", "y", 0, 10, seed=1)
    assert u.filter("y = 0").count() == 10 and u.filter("y = 1").count() == 5
    assert rows(u.select("id")) == rows(transform.undersample(df.repartition(7), "id", "y", 0, 10, seed=1).select("id"))
    s = transform.smote(df, "id", "v", "y", 1, per_row=3, k=2)
    assert s.count() == 15 and all(0 <= r.v[0] <= 4 for r in s.collect())
    assert transform.smote(df.filter("id = 1"), "id", "v", "y", 1).count() == 0


def test_neighbours_and_domain(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(99, None)], "id bigint, v array<double>").repartition(3)
    got = rows(distance.nearest(df, df, 3, "euclidean", skip_self=True).select("query_id", "rank", "id"))
    d = np.linalg.norm(m[:, None] - m[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == [(i, k + 1, int(j)) for i in range(60) for k, j in enumerate(np.argsort(d[i])[:3])]
    # six binary rows in two groups, two queries, k = 2: both indices are 1 and the neighbours lie in the query's group
    train = [[1, 1, 1, 0, 0, 0, 0, 0, 0], [0, 1, 1, 0, 0, 0, 0, 0, 0], [1, 0, 1, 0, 0, 0, 0, 0, 0]]
    assert distance.distances(np.array(train, float), np.array(train, float), "jaccard")[0, 1] == 1 - 2 / 3
    assert rows(distance.tanimoto_pairs(spark.createDataFrame([(1, [0, 1])], "id bigint, bits array<int>"), spark.createDataFrame([(2, [1, 2]), (3, [])], "id bigint, bits array<int>"), 8)) == [(1, 2, 1 - 1 / 3), (1, 3, 1.0)]


def test_butina_like_one_by_one(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(50, 2))
    d = np.linalg.norm(m[:, None] - m[None], axis=2)
    near = d <= 0.7
    order = sorted(range(50), key=lambda i: (-near[i].sum(), i))
    cluster, n = {}, 0
    for i in order:
        if i not in cluster:
            for j in np.flatnonzero(near[i]):
                cluster.setdefault(int(j), n)
            n += 1
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id bigint, v array<double>")
    assert dict(rows(distance.butina(df, "euclidean", 0.7))) == cluster


def test_splits_are_disjoint_and_complete(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}", i % 3) for i in range(100)], "id bigint, g string, y int")
    for s in (splits.index_split(df, "id", 0.1, 0.2), splits.random_split(df, "id", 0.1, 0.2, 5), splits.scaffold_split(df, "g", 0.1, 0.2), splits.stratified_split(df, "id", "y", 0.1, 0.2)):
        assert s.count() == 100 == s.select("id").distinct().count()
    assert rows(splits.index_split(df, "id", 0.1, 0.2).groupBy("subset").count()) == [("test", 20), ("train", 70), ("valid", 10)]
    assert rows(splits.random_split(df, "id", 0.1, 0.2, 5).select("id", "subset")) == rows(splits.random_split(df.repartition(9), "id", 0.1, 0.2, 5).select("id", "subset"))
    assert splits.scaffold_split(df, "g", 0.1, 0.2).groupBy("g").agg(F.count_distinct("subset").alias("n")).filter("n > 1").count() == 0
    assert splits.kfold(df, F.col("id"), 4).filter("subset = 'valid'").count() == 100
    assert splits.index_split(df.limit(0), "id", 0.1, 0.1).count() == 0


def test_genetic_split_improves(spark):
    h = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(np.random.default_rng(0).integers(1, 30, (40, 2)))], "g int, a int, b int")
    long = h.select(F.col("g").alias("group"), F.inline(F.array(*[F.struct(F.lit(i).alias("task"), F.lit(0).alias("bin"), F.col(c).alias("n")) for i, c in enumerate("ab")])))
    s = splits.genetic_group_split(long, 40, 2, weights=(0.0, 0.0, 1.0, 0.0), generations=15, population=30, seed=3).select(F.col("group").alias("g"), "subset")
    total = s.join(h, "g").groupBy("subset").agg(F.sum("a").alias("a")).collect()
    share = {r.subset: r.a / sum(x.a for x in total) for r in total}
    assert abs(share["train"] - 0.8) < 0.12


def test_registry_language(spark):
    df = spark.createDataFrame([(1, "NN", 0.5, 10), (2, "RF", 0.9, 10), (3, "NN", NAN, 20), (4, None, 0.9, 20)], "id int, m string, s double, n int")
    ids = lambda q: [r[0] for r in rows(registry.match(df, q).select("id"))]
    assert ids({"m": "NN"}) == [1, 3]
    assert ids({"s": [">", 0.1]}) == [1, 2, 4]
    assert ids({"m": ["!=", "NN"]}) == [2]
    assert ids({"s": ["max", None]}) == [2, 4]
    assert ids({"n": ["max", 1], "s": ["max", 2]}) == [4]
    assert ids({"m": {"$in": ["NN", "RF"]}, "n": {"$lt": 15}}) == [1, 2]
    assert ids({"nothing": 3}) == []


def test_best_model_and_ranks(spark):
    df = spark.createDataFrame([("d", 1, 0.5), ("d", 2, 0.5), ("d", 3, NAN), (None, 4, 0.9), ("e", 5, -0.0)], "k string, id int, s double")
    assert rows(registry.best_model(df, ["k"], "s", "id")) == [("d", 1, 0.5), ("e", 5, 0.0)]
    r = registry.spearman(spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (2.0, 1.0), (None, 1.0)], "a double, b double"), "a", "b").first()
    assert r.n == 3 and math.isclose(r.rho, -0.8660254037844387)


def test_joins(spark):
    a = spark.createDataFrame([("k", "b", 1.0), (None, "z", 9.0)], "k string, id string, v double")
    b = spark.createDataFrame([("k", "a", 3.0), ("k", "c", None)], "k string, id string, v double")
    assert rows(joins.merge_sources([a, b], "k", "id", "v", "mean")) == [("k", "a", 2.0)]
    assert rows(joins.merge_sources([a, b], "k", "id", "v", "mode")) == [("k", "a", 1.0)]
    n = joins.with_ordinal(spark.createDataFrame([(x,) for x in (5, 3, 9, 3)], "x int"), "x")
    assert rows(n) == [(3, 0), (3, 1), (5, 2), (9, 3)]
    c = joins.compute_missing(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), "k", spark.createDataFrame([("a", 1)], "k string, f int"), lambda t: t.withColumn("f", F.lit(2)))
    assert sorted((r.k or "-", r.f) for r in c.collect()) == [("-", None), ("a", 1), ("b", 2)]
