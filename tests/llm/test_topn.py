import random

from conftest import rows
from replicata.llm.topn import first_per_key, top_n_per_group

NAN, INF = float("nan"), float("inf")


def test_against_brute_force(spark):
    rng = random.Random(4)
    data = []
    for i in range(3000):
        g = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
        s = rng.choice([None, NAN, INF, -INF, 0.0, -0.0, *[round(rng.random(), 1) for _ in range(20)]])
        data.append((g, rng.choice(["x", "y"]), s, i))
    ok = [(g, t, s + 0.0, i) for g, t, s, i in data if g and s is not None and s == s and abs(s) != INF]
    want = []
    for key in {(g, t) for g, t, _, _ in ok}:
        best = sorted((-s, i) for g, t, s, i in ok if (g, t) == key)[:7]
        want += [(*key, i, n + 1) for n, (_, i) in enumerate(best)]
    df = spark.createDataFrame(data, "g string, t string, s double, id bigint").repartition(9)
    assert rows(top_n_per_group(df, ["g", "t"], "s", "id", 7)) == sorted(want)


def test_one_group_over_all_partitions(spark):
    df = spark.range(5000).selectExpr("'g' as g", "0.0 as s", "id", "'z' as pid", "1 as local_pos")
    assert rows(top_n_per_group(df, ["g"], "s", "id", 3000))[-1] == ("g", 2999, 3000)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([("g", 1.0, 5), ("g", 1.0, 5), ("g", 2.0, None)], "g string, s double, id bigint")
    assert sorted((r.id or 0, r.position) for r in top_n_per_group(df, ["g"], "s", "id", 2).collect()) == [(0, 1), (5, 2)]
    assert top_n_per_group(df.limit(0), ["g"], "s", "id", 2).count() == 0


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, "w")], "k string, id bigint, v string")
    assert rows(first_per_key(df, "k", "id", ["v"])) == [(1, "y"), (3, "z"), (4, "w")]
