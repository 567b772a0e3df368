"""Operators that have no SQL beside them, against brute force; empty, tied and missing input."""

import heapq
import json
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from replicata.operators import curate, distance, metrics, models, networks, registry, splits, tracking
from replicata.plans.range_scan import running_sums
from replicata.sources import files


def test_running_sums(spark):
    rng = random.Random(1)
    group = lambda: "hot" if rng.random() < 0.4 else rng.choice([None, "a", "b", "c"])
    data = [(group(), i, rng.choice([None, rng.randrange(9)]), float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, o int, x int, y double").repartition(5)
    want = []
    for g in {d[0] for d in data}:
        sx, sy = 0, 0.0
        for _, o, x, y in sorted((d for d in data if d[0] == g), key=lambda d: d[1]):
            sx, sy = sx + (x or 0), sy + y
            want.append((g or "", o, sx, sy))
    key = lambda r: (r.g or "", r.o, r.cx, r.cy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(key(r) for r in running_sums(df, ["g"], [F.col("o")], {"cx": "x", "cy": "y"}).collect()) == sorted(want)
        assert [r.c for r in running_sums(df, [], [F.col("o")], {"c": "x"}).orderBy("o").collect()] == np.cumsum([d[2] or 0 for d in data]).tolist()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert running_sums(df.limit(0), ["g"], [F.col("o")], {"c": "x"}).count() == 0


def test_quantiles_and_mode(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 else rng.choice([None, "a", "b"]), rng.choice([None, float("nan"), *map(float, range(12))])) for i in range(300)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.a, r.b) for r in curate.quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.31}).collect()}
    for g in ("hot", None, "a", "b"):
        v = [x for k, x in data if k == g and x is not None and not math.isnan(x)]
        assert np.allclose(got[g], np.quantile(v, [0.5, 0.31]))
    assert curate.quantiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0
    m = curate.mode(spark.createDataFrame([("a", 2), ("a", 1), ("b", None), (None, 3), (None, 3)], "g string, v int"), ["g"], "v")
    assert sorted((r.g or "", r["mode"], r.mode_n) for r in m.collect()) == [("", 3, 2), ("a", 1, 1)]


def test_bad_duplicates_by_list_and_by_rounds(spark):
    rng = random.Random(3)
    data = [(rng.choice("abcdefgh"), rng.choice([1.0, 1.1, 1.2, 5.0, 9.0, -2.0, 0.0, None, float("nan")])) for _ in range(200)] + [("single", 4.0), ("zero", 0.0), ("zero", 0.0)]
    df = spark.createDataFrame(data, "k string, v double")
    key = lambda d: sorted((r.key, round(r.mean, 9), -1 if r.std is None else round(r.std, 6), r.n) for r in d.collect())
    one = key(curate.remove_bad_duplicates(df, "k", "v", 60.0, 3.0))
    assert one == key(curate.remove_bad_duplicates(df, "k", "v", 60.0, 3.0, long_list=0)) and ("single", 4.0, -1, 1) in one
    assert curate.remove_bad_duplicates(df.limit(0), "k", "v", 60.0, 3.0).count() == 0


def _groups(spark):
    rng = random.Random(4)
    data = [(i, "hot" if i % 3 == 0 else rng.choice([None, *[f"g{j}" for j in range(25)]])) for i in range(200)]
    return data, spark.createDataFrame(data, "id int, g string")


def test_smush_and_scaffold_split(spark):
    data, df = _groups(spark)
    sizes: dict = {}
    for _, g in data:
        sizes[g] = sizes.get(g, 0) + 1
    order = sorted(sizes.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
    heap = [(0, s) for s in range(6)]
    for _, n in order:
        k, s = heapq.heappop(heap)
        heapq.heappush(heap, (k + n, s))
    got = splits.smush(df, "g", 6).collect()
    load: dict = {}
    for r in got:
        load[r.super_group] = load.get(r.super_group, 0) + r.n
    assert {r["group"] for r in got} == set(sizes) and sorted(load.items()) == sorted((s, n) for n, s in heap)
    total, a, b, want = len(data), 0, 0, {}
    for g, n in order:
        if a + n <= 0.6 * total + 1e-9:
            a, want[g] = a + n, "train"
        elif a + b + n <= 0.8 * total + 1e-9:
            b, want[g] = b + n, "valid"
        else:
            want[g] = "test"
    assert {r.id: r.subset for r in splits.scaffold_split(df, "g", 0.2, 0.2).collect()} == {i: want[g] for i, g in data}
    folds = splits.cluster_folds(df, "g", 3).collect()
    assert len(folds) == 200 and all(len({r.fold for r in folds if r.g == g}) == 1 for g in sizes)
    assert splits.smush(df.limit(0), "g", 6).count() == 0 and splits.scaffold_split(df.limit(0), "g", 0.1, 0.1).count() == 0


def test_split_by_name(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}", float(i)) for i in range(50)], "id int, g string, date double")
    for name in ("index", "random", "scaffold", "stratified"):
        assert splits.split_with(df, name, "id", "g", 0.1, 0.2).count() == 50
    k = splits.split_with(df, "k_fold_cv", "id", test=0.2, folds=4)
    assert k.filter("subset = 'test'").count() == 40 and k.filter("subset = 'valid'").count() == 40 and k.count() == 200
    with pytest.raises(ValueError):
        splits.split_with(df, "nonsense", "id")


def test_genetic_fitness_terms(spark):
    rng = random.Random(5)
    members = spark.createDataFrame([(i, i % 8) for i in range(80)], "id int, g int")
    pairs = [(i, j, rng.random()) for i in range(0, 80, 2) for j in range(80) if rng.random() < 0.2]
    near = splits.near_masks(spark.createDataFrame(pairs, "a int, b int, distance double"), members, "id", "g", 0.3)
    pop = np.array([[rng.randrange(3) for _ in range(8)] for _ in range(4)])
    got = splits._far_fractions(near, 8)(pop)
    for c, row in enumerate(pop):
        for part in (1, 2):
            asked = {a for a, _, _ in pairs if row[a % 8] == part}
            close = {a for a, b, d in pairs if a in asked and a != b and d < 0.3 and row[b % 8] == 0}
            assert abs(got[c, part - 1] - ((len(asked) - len(close)) / len(asked) if asked else 0)) < 1e-9
    data = spark.createDataFrame([(i, i % 8, float(i % 13), float(i) if i % 3 else None) for i in range(400)], "id int, g int, a double, b double")
    h = splits.group_histogram(data, "g", ["a", "b"])
    best = splits.genetic_group_split(h, 8, 2, masks=near, generations=4, population=10, seed=1)
    again = splits.genetic_group_split(h, 8, 2, masks=near, generations=4, population=10, seed=1)
    assert rows(best) == rows(again) and {r.subset for r in best.collect()} == {"train", "valid", "test"}
    r = best.first()
    assert abs(r.fitness - (r.far_test + r.far_valid + r.ratio + r.response) / 4) < 1e-9 and r.ratio > 0.6


def test_least_bias(spark):
    rng = np.random.default_rng(6)
    data = [(int(i), int(i % 2), rng.random(8).tolist(), rng.random(8).tolist()) for i in range(120)]
    near = spark.createDataFrame(data, "id int, y int, to_active array<double>, to_inactive array<double>")
    first = splits.ave_minimize(near, "id", "y", 0.25, generations=0, population=1, blocks=8, seed=3).first().bias
    best = splits.ave_minimize(near, "id", "y", 0.25, generations=6, population=12, blocks=8, seed=3)
    assert best.first().bias <= first and best.filter("is_test").count() == 2


def test_multiclass_metrics(spark):
    df = spark.createDataFrame([("t", 0, [0.7, 0.2, 0.1]), ("t", 1, [0.1, 0.8, 0.1]), ("t", 1, [0.6, 0.3, 0.1]), ("t", None, [1.0, 0.0, 0.0]), ("t", 2, None)], "k string, y int, p array<double>")
    r = metrics.multiclass_metrics(df, "y", "p", ["k"]).first()
    assert abs(r.precision - 0.75) < 1e-9 and abs(r.recall - 0.75) < 1e-9 and abs(r.accuracy - 2 / 3) < 1e-9 and abs(r.roc_auc - 1.0) < 1e-9
    assert metrics.multiclass_metrics(df.limit(0), "y", "p", ["k"]).count() == 0
    assert metrics.score_with(df, "y", "p", ["k"], "classification", 3).count() == 1


@pytest.mark.parametrize("loss", ["l2", "log", "hybrid", "poisson"])
def test_network_slopes(loss):
    rng = np.random.default_rng(7)
    out, y, conc = rng.normal(5, 1, 20), rng.random(20), np.where(rng.random(20) < 0.5, 1000.0, np.nan)
    each, slope = networks.losses(loss, out, y, conc)
    eps = 1e-6
    numeric = (networks.losses(loss, out + eps, y, conc)[0] - networks.losses(loss, out - eps, y, conc)[0]) / (2 * eps)
    assert np.allclose(slope, numeric, atol=1e-4)
    net, x = networks.Network([3, 5], 1), rng.normal(size=(9, 3))
    _, kept = net.forward(x)
    grads = net.backward(kept, np.ones(9))
    for a, g in zip(net.flat(), grads, strict=True):
        i = tuple(0 for _ in a.shape)
        a[i] += eps
        up = net.forward(x)[0].sum()
        a[i] -= 2 * eps
        down = net.forward(x)[0].sum()
        a[i] += eps
        assert abs((up - down) / (2 * eps) - g[i]) < 1e-4


def test_network_learns_and_stops(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 2))
    data = [(i, [float(v) for v in r], float(2 * r[0] - r[1]), "valid" if i % 5 == 0 else "train", i % 2) for i, r in enumerate(x)] + [(900, None, 1.0, "train", 0), (901, [0.0, 1.0], None, "train", 0)]
    df = spark.createDataFrame(data, "id int, features array<double>, y double, subset string, fold int")
    net, history, best = networks.fit_network(df, [8], epochs=40, rate=0.05, patience=5)
    assert history[best][1] < 0.5 * history[0][1] and best == min(range(len(history)), key=lambda i: history[i][1])
    p = {r.id: r.pred for r in networks.predict_network(net, df, "id").collect()}
    assert p[900] is None and np.mean([(p[i] - d[2]) ** 2 for i, d in enumerate(data[:200])]) < 2
    final, n = networks.kfold_epochs(df, 2, [4], epochs=6, rate=0.05)
    assert 0 <= n < 6 and len(final.w) == 2


def test_tracking(spark, tmp_path):
    path = str(tmp_path / "registry")
    for i, score in enumerate((0.1, 0.5)):
        tracking.save_model(spark, path, "c", {"model_uuid": "u1", "dataset_key": "old", "training_metrics": [{"subset": "train", "r2": score}], "n": i})
    tracking.save_model(spark, path, "d", {"model_uuid": "u2", "dataset_key": "x"})
    docs = spark.read.parquet(path)
    assert json.loads(tracking.by_uuid(docs, ["u1"]).first().document)["n"] == 1 and tracking.by_uuid(docs, ["u1"], ["d"]).count() == 0
    assert tracking.collection_of(docs, "u2") == "d"
    with pytest.raises(ValueError):
        tracking.collection_of(docs, "u3")
    t = tracking.training_table(tracking.latest(docs), ["r2"]).filter("model_uuid = 'u1'").first()
    assert t.train_r2 == 0.5 and t.valid_r2 is None
    tracking.export_model(docs, "u1", str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["model_uuid"] == "u1"
    p = tracking.patch_dataset_key(tracking.latest(docs), "old", "new").filter("model_uuid = 'u1'").first()
    assert p.dataset_key == "new" and json.loads(p.document)["dataset_key"] == "new"
    v = spark.createDataFrame([("1.5.2",), ("1.4.0",), (None,)], "v string").select(tracking.compatible(F.col("v"), [["1.5", "1.6"]], "1.6.3").alias("c"))
    assert [r.c for r in v.collect()] == [True, False, None]


def test_search_finds_the_least():
    space = {"x": ("uniform", -5.0, 5.0), "k": ("choice", ["a", "b"]), "n": ("int", 1, 9), "e": ("loguniform", 1e-4, 1.0)}

    def score(p):
        if p["k"] == "b" and p["n"] == 1:
            raise RuntimeError
        return 1 - (p["x"] - 2) ** 2 / 10 - (0.0 if p["k"] == "a" else 1.0)

    got = tracking.bayes_search(space, score, 60, seed=1)
    assert got[0]["params"]["k"] == "a" and abs(got[0]["params"]["x"] - 2) < 0.7 and got == tracking.bayes_search(space, score, 60, seed=1)
    assert tracking.loss_of("regression", None) == 1 and tracking.loss_of("classification", 0.75) == 25


def test_ward_clusters():
    x = np.array([0.0, 0.1, 5.0, 5.2, 20.0])
    d = np.abs(x[:, None] - x[None, :])
    assert registry.ward_clusters(d, 1.0) == [1, 1, 2, 2, 3] and registry.ward_clusters(d, 0.01) == [1, 2, 3, 4, 5] and registry.ward_clusters(d, 99.0) == [1] * 5
    assert registry.ward_clusters(np.zeros((0, 0)), 1.0) == []


def test_domain_driver(spark):
    t = spark.createDataFrame([(i, [float(i), None if i else 4.0, None]) for i in range(12)], "id bigint, v array<double>")
    q = spark.createDataFrame([(100, [3.0, None, 7.0]), (101, None)], "id bigint, v array<double>")
    r = distance.applicability(q, t, 2).collect()
    assert [(x.query_id, sorted(x.neighbours)) for x in r] in ([(100, [2, 3])], [(100, [3, 4])])
    assert distance.applicability(q, t, 2, "local_density", most_train=5).count() == 1


def test_sources(spark, tmp_path):
    import tarfile

    (tmp_path / "a.csv").write_text("id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("id,y\n3,4\n5,6\n")
    with tarfile.open(tmp_path / "set.tar.gz", "w:gz") as t:
        for n in ("a.csv", "b.csv"):
            t.add(tmp_path / n, n)
    cat = spark.createDataFrame([("k", "o1", str(tmp_path / "set.tar.gz")), ("m", "o2", str(tmp_path / "a.csv"))], "dataset_key string, object_id string, path string")
    assert {k: v.count() for k, v in files.fetch(spark, cat, dataset_key="k").items()} == {"a.csv": 1, "b.csv": 2}
    assert rows(files.fetch(spark, cat, object_id="o2", id_col="id")) == [("1", 2)]
    with pytest.raises(ValueError):
        files.fetch(spark, cat, dataset_key="nothing")


def test_small_operators(spark):
    df = spark.createDataFrame([(3, ["C", "N"]), (1, ["C", "Pd"]), (2, None)], "id int, e array<string>")
    assert rows(curate.exclude_by_elements(df, "e").select("id")) == [(3,)]
    assert [r.compound_id for r in curate.generated_ids(df.select("id"), "id").orderBy("id").collect()] == [f"compound_{i:06d}" for i in range(3)]
    assert curate.to_model_schema(df, {"id": "key", "zz": "q"}).columns == ["key", "e"] and curate.to_model_schema(df.withColumnRenamed("id", "key"), {"id": "key"}, back=True).columns == ["id", "e"]
    with pytest.raises(ValueError):
        curate.require_columns(df, ["id", "zz"])
    assert sorted((r.unit or "", r.n) for r in curate.unknown_units(spark.createDataFrame([("nM",), ("foo",), (None,)], "u string"), "u").collect()) == [("", 1), ("foo", 1)]
    now = iter([0.0, 0.0, 10.0, 20.0])
    limit = models.TimeLimit(25.0, lambda: next(now))
    assert [limit.another(), limit.another(), limit.another()] == [True, True, False]


def test_selection_and_clusters(spark):
    rng = np.random.default_rng(9)
    data = spark.createDataFrame([(i, [float(v) for v in r], float(r[0] + r[1])) for i, r in enumerate(rng.normal(size=(40, 3)))], "id int, features array<double>, y double")
    m = models.fit(data, "linear", classification=False)
    docs = spark.createDataFrame([("a",), ("b",), ("broken",)], "model_uuid string")

    def load(u):
        if u == "broken":
            raise ValueError(u)
        return m

    assert models.predict_selection(docs, load, data, "id").groupBy("model_uuid").count().count() == 2
    c = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "feature int, cluster int")
    got = {r.cluster: r.importance for r in models.cluster_importance(m, data, "id", c, repeats=3).collect()}
    assert got[1] > 0.5 and abs(got[2]) < 1e-6


def test_array_moments(spark):
    from replicata.operators.transform import array_moments, normalize_x, x_stats

    rng = np.random.default_rng(10)
    data = [(int(i % 3) if i % 7 else None, [None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else float(v) for v in rng.normal(1e6, 1, 2 + i % 2)]) for i in range(60)] + [(0, None), (0, [])]
    df = spark.createDataFrame(data, "y int, v array<double>").repartition(3)
    for r in array_moments(df, "v", "y").collect():
        x = [row[r.feature] for y, row in data if row and len(row) > r.feature and (y if y is not None else -1) == r.label and row[r.feature] is not None and not math.isnan(row[r.feature])]
        assert r.n == len(x) and abs(r.mean - np.mean(x)) < 1e-6 and abs(r.m2 - np.var(x) * len(x)) < 1e-6
    s = x_stats(df, "v").first()
    assert len(s.means) == len(s.stds) == 3 and abs(s.stds[0] - np.std([v[0] for _, v in data if v and v[0] is not None and not math.isnan(v[0])])) < 1e-6
    empty = x_stats(df.limit(0), "v").first()
    assert empty.means == [] and empty.stds == [] and normalize_x(df.limit(0), "v").count() == 0
