import random

from conftest import rows
from pyspark.sql import functions as F
from replicata.llm import groups


def _components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def test_components_against_union_find(spark):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(220)]
    # a chain and a star, the worst cases for the number of rounds and for one node's degree
    pairs += [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("s000", f"s{i:03}") for i in range(1, 300)]
    pairs = [(a, b) for a, b in pairs if a != b]
    e = spark.createDataFrame([(max(p), min(p)) for p in pairs] * 2, "u string, v string")
    assert rows(groups.connected_components(e)) == _components(pairs)
    # the star's centre and others count as heavy and are dealt to several tasks
    assert rows(groups.connected_components(e, heavy_rows=20)) == _components(pairs)


def test_entities_nulls_and_empty(spark):
    r = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "z"), ("e", None), (None, "x"), ("a", "x")], "node string, entity string")
    assert rows(groups.connected_components(groups.shared_entity_edges(r))) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert rows(groups.connected_components(groups.shared_entity_edges(r, heavy_rows=1), heavy_rows=1)) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert groups.connected_components(groups.shared_entity_edges(r.limit(0))).count() == 0


def test_torn_groups(spark):
    m = spark.createDataFrame([("s", 0, "a", "train"), ("s", 0, "b", "test"), ("s", 1, "a", "train"), ("s", 1, "b", "train"), ("t", 0, "q", "valid"), ("t", 0, "q", "train"), ("t", 0, "r", None), ("t", 0, None, "test")], "split_uuid string, fold int, node string, subset string")
    c = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, component string")
    assert rows(groups.torn_groups(m, c)) == [("s", 0, "a"), ("t", 0, "q")]


def test_shares(spark):
    df = spark.range(20000).select(groups.split_by_shares(F.col("id").cast("string"), F.lit(0.8), F.lit(0.1)).alias("s")).groupBy("s").count()
    n = {r.s: r["count"] / 20000 for r in df.collect()}
    assert abs(n["train"] - 0.8) < 0.02 and abs(n["valid"] - 0.1) < 0.02 and abs(n["test"] - 0.1) < 0.02
