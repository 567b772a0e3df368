from conftest import rows

from replicata.plans.skew import join_pairs, join_per_key


def test_pairs_of_hot_keys(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(60)] + [(None, 99), ("hot", 1)], "k string, a int")
    right = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}", i) for i in range(50)] + [(None, 99), ("none", 5)], "k string, b int")
    want = rows(left.join(right, "k"))
    assert rows(join_pairs(left, right, ["k"])) == want and len(want) > 800
    assert rows(join_pairs(left, right, ["k"], pairs_per_task=20)) == want
    assert join_pairs(left.limit(0), right, ["k"], pairs_per_task=1).count() == 0


def test_left_join_per_key(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(60)] + [(None, 99)], "k string, a int")
    per_key = spark.createDataFrame([("hot", 40, "x"), ("k3", 3, "y"), ("none", 1, "z")], "k string, n long, v string")
    key = lambda r: [(x or "", a, v or "") for x, a, v in r]
    want = sorted(key(big.join(per_key.drop("n"), "k", "left").collect()))
    assert sorted(key(join_per_key(big, per_key, ["k"], "n", how="left").collect())) == want
    assert sorted(key(join_per_key(big, per_key, ["k"], "n", heavy_rows=5, how="left").collect())) == want
