import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from replicata.operators import curate

NAN, INF = float("nan"), float("inf")


def _df(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_relations(spark):
    df = _df(spark, [(1, None), (2, "'>='"), (3, "<<"), (4, "?"), (5, ""), (6, "~")], "id int, relation string")
    assert rows(curate.standardize_relations(df, "relation").select("id", "relation")) == [(1, "="), (2, ">"), (3, "<"), (5, "="), (6, "=")]
    assert rows(curate.standardize_relations(df, "relation", invert=True).select("id", "relation"))[1] == (2, "<")


def test_units(spark):
    df = _df(spark, [(1, 1000.0, "nM", "<"), (2, 1.0, "uM", ">"), (3, -1.0, "nM", "="), (4, None, "nM", "="), (5, NAN, "nM", "=")], "id int, v double, u string, r string")
    got = curate.neg_log_response(df, "v", "u", "r", "p")
    assert [(i, round(p, 9), r) for i, r, p in rows(got.select("id", "r", "p"))] == [(1, 6.0, ">"), (2, 6.0, "<")]
    with pytest.raises(Exception, match="unknown unit"):
        curate.neg_log_response(df.unionByName(_df(spark, [(9, -1.0, "furlong", "=")], df.schema)), "v", "u", "r", "p").collect()


def test_filters_keep_or_drop_missing_values(spark):
    df = _df(spark, [(1, "a"), (2, "b"), (3, None)], "id int, c string")
    assert [r[0] for r in rows(curate.filter_values(df, "c", ["a"], True))] == [1]
    assert [r[0] for r in sorted(curate.filter_values(df, "c", ["a"], False).select("id").collect())] == [2, 3]
    c = _df(spark, [(1, "is BAD"), (2, "bad, nan"), (3, None), (4, " "), (5, "Exact"), (6, "exact")], "id int, c string")
    assert [r[0] for r in rows(curate.filter_comments(c, "c", ["bad"], ["Exact"]).select("id"))] == [2, 3, 4, 6]
    d = _df(spark, [(1, INF), (2, NAN), (3, None), (4, 1.0), (5, -INF)], "id int, v double")
    assert [r[0] for r in rows(curate.drop_inf(d).select("id"))] == [2, 3, 4]
    keep, reject = curate.with_rejects(d, F.col("v") < 5)
    assert keep.count() + reject.count() == 5
    e = _df(spark, [("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, id int")
    assert [r[0] for r in rows(curate.remove_all_duplicates(e, ["k"]).select("id"))] == [3, 4]


def test_weights(spark):
    y, w = curate.make_weights(["a", "b"])
    y0, _ = curate.make_weights(["a", "b"], classification=True)
    got = _df(spark, [(1.0, NAN), (None, 2.0)], "a double, b double").select(y.alias("y"), w.alias("w"), y0.alias("y0")).collect()
    assert [(r.y, r.w, r.y0) for r in got] == [([1.0, None], [1.0, 0.0], [1.0, 0.0]), ([None, 2.0], [0.0, 1.0], [0.0, 2.0])]


def test_censored_means(spark):
    df = _df(spark, [("l", 3.0, "<"), ("l", 2.0, "<"), ("r", 3.0, ">"), ("r", 5.0, ">"), ("n", 1.0, ""), ("n", 2.0, "="), ("m", 5.0, ""), ("m", 5.4, "="), ("m", 4.5, "<"), ("m", 6.0, ">"), ("n", NAN, ""), (None, 1.0, "")], "k string, v double, r string")
    sigma = _df(spark, [(0.5,)], "rmsd double")
    got = {r.key: (r.relation, round(r.value, 4)) for r in curate.censored_means(df, "k", "v", "r", sigma).collect()}
    assert got == {"l": ("<", 2.0), "r": (">", 5.0), "n": ("", 1.5), "m": ("", 5.223)}


def test_mle_against_grid():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(2, 8))
        v, s = rng.normal(5, 1, n), rng.integers(-1, 2, n)
        s[0] = 0
        sigma = float(rng.uniform(0.2, 1.5))

        def ll(m):
            phi = lambda z: max(0.5 * math.erfc(-z / math.sqrt(2)), 1e-300)
            return sum(-((x - m) ** 2) / (2 * sigma**2) if c == 0 else math.log(phi((x - m) / sigma)) if c < 0 else math.log(phi((m - x) / sigma)) for x, c in zip(v, s, strict=True))

        grid = np.linspace(0, 10, 20001)
        assert abs(curate.mle_censored_mean(v, s, sigma) - grid[np.argmax([ll(m) for m in grid])]) < 1e-3
    assert curate.mle_censored_mean(np.array([2.0, 4.0, 1.0]), np.array([0, 0, -1]), 0.0) == 3.0


def test_rmsd_and_outliers(spark):
    df = _df(spark, [("a", 1.0, ""), ("a", 3.0, "="), ("b", 7.0, ""), ("c", 1.0, "<"), ("c", 9.0, "<")], "k string, v double, r string")
    assert curate.replicate_rmsd(df, "k", "v", "r").first().rmsd == 1.0
    assert curate.replicate_rmsd(df.limit(0), "k", "v", "r").first().rmsd == 1.0
    o = _df(spark, [("a", 1.0), ("a", 1.2), ("a", 9.0), ("b", 50.0), ("c", None), ("c", 1.0), (None, 2.0)], "k string, v double")
    assert rows(curate.remove_outliers(o, "k", "v", 1.0)) == [("a", 1.0), ("a", 1.2), ("b", 50.0)]


def test_bad_duplicates(spark):
    df = _df(spark, [("a", 10.0), ("a", 11.0), ("a", 10.5), ("a", 40.0), ("b", -5.0), ("b", 5.0), ("c", 3.0), ("d", NAN)], "k string, v double")
    got = {r.key: (round(r.mean, 6), r.n) for r in curate.remove_bad_duplicates(df, "k", "v", 50.0, 1e9).collect()}
    assert got["a"] == (10.5, 3)
    assert got["c"] == (3.0, 1)
    assert "d" not in got
    again = curate.remove_bad_duplicates(_df(spark, [("a", 10.0), ("a", 11.0), ("a", 10.5)], "k string, v double"), "k", "v", 50.0, 1e9).first()
    assert (again.mean, again.n) == (10.5, 3)


def test_aggregate_assay(spark):
    df = _df(spark, [("k1", 5.0, "", "x2"), ("k1", 7.0, "", "x1"), ("k2", 4.0, "<", "y"), ("", 1.0, "", "z"), (None, 1.0, "", "w")], "k string, v double, r string, id string")
    assert rows(curate.aggregate_assay(df, "k", "v", "r", "id")) == [("x1", "k1", "", 6.0, 1), ("y", "k2", "<", 4.0, 0)]
    assert curate.aggregate_assay(df.limit(0), "k", "v", "r", "id").count() == 0


def test_many_to_one(spark):
    ok = _df(spark, [("a", "b"), ("c", "d"), ("a", "b"), ("b", "b")], "id string, key string")
    curate.check_many_to_one(ok, "id", "key")
    for data, message in [([("a", "b"), ("c", "b"), ("c", "d")], "several keys"), ([(None, "f")], "missing id"), ([("f", None), (None, "g")], "missing key")]:
        with pytest.raises(ValueError, match=message):
            curate.check_many_to_one(_df(spark, data, "id string, key string"), "id", "key")


def test_tables(spark):
    df = _df(spark, [("a", "x"), ("a", "x"), (None, None)], "k string, l string")
    assert sorted((r[0] or "-", r[1]) for r in curate.freq_table(df, "k").collect()) == [("-", 1), ("a", 2)]
    with pytest.raises(Exception, match="many-to-one"):
        curate.labeled_freq_table(df.unionByName(_df(spark, [("a", "y")], df.schema)), ["k", "l"]).collect()
    c = _df(spark, [("a", 1, 1, "i2", 0.0), ("a", 0, 0, "i1", 1.0), ("b", 5, 2, "i3", 0.0), (None, 9, 3, "i4", 1.0)], "k string, o int, n int, id string, w double")
    assert rows(curate.compact(c, "k", "o", "id", ["w"]).select("k", "id", "w")) == [("a", "i1", 1.0), ("b", "i3", 0.0)]


def test_ensemble(spark):
    df = _df(spark, [("a", 1.0, 1.0), ("a", 3.0, 0.5), ("a", NAN, 1.0), ("b", None, 1.0)], "id string, p double, s double")
    assert {r.id: r.pred for r in curate.ensemble(df, "id", "p", "mean").collect()} == {"a": 2.0, "b": None}
    assert abs(curate.ensemble(df, "id", "p", "weighted", "s").filter("id = 'a'").first().pred - 7 / 3) < 1e-12
    with pytest.raises(Exception, match="deviation is 0"):
        curate.ensemble(_df(spark, [("a", 1.0, 0.0)], df.schema), "id", "p", "weighted", "s").collect()
