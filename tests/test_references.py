import datetime as dt
import random

from conftest import rows
from replicata.operators.references import orphan_references, parent_runs

T = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
REFS, PARENTS = "ref_table string, row_id bigint, key string, at timestamp_ntz", "key string, start timestamp_ntz, end timestamp_ntz"


def _brute(refs, parents):
    out = []
    for t, i, k, at in refs:
        if k is None:
            continue
        alive = at is not None and any(p == k and s is not None and s <= at and (e is None or e > at) for p, s, e in parents)
        if not alive:
            out.append((t, i))
    return sorted(out)


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    # one key holds a third of all rows
    key = lambda: "hot" if rng.random() < 0.34 else rng.choice([None, *"abcdefgh"])
    parents = [(key(), rng.choice([None, T(rng.randrange(500))]), rng.choice([None, T(rng.randrange(500))])) for _ in range(60)]
    parents = [(k, s, e if e is None or s is None or e > s or rng.random() < 0.3 else None) for k, s, e in parents]
    refs = [(rng.choice("xy"), i, key(), T(rng.randrange(500)) if rng.random() < 0.95 else None) for i in range(800)]
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).select("ref_table", "row_id")
    assert rows(got) == _brute(refs, parents)


def test_boundaries_and_reasons(spark):
    parents = [("a", T(10), T(20)), ("a", T(15), T(30)), ("b", T(50), None)]
    refs = [("t", 1, "a", T(10)), ("t", 2, "a", T(29)), ("t", 3, "a", T(30)), ("t", 4, "a", T(9)), ("t", 5, "b", T(49)), ("t", 6, "b", T(50)), ("t", 7, "c", T(1)), ("t", 8, None, T(1)), ("t", 9, "b", None)]
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).select("row_id", "reason")
    assert rows(got) == [(3, "ended"), (4, "not_yet"), (5, "not_yet"), (7, "not_yet"), (9, "not_yet")]


def test_empty_tables_repeats_and_extra_columns(spark):
    none, ref = spark.createDataFrame([], PARENTS), spark.createDataFrame([("t", 1, "a", T(1))] * 2, REFS)
    assert orphan_references(ref, none).count() == 2
    assert orphan_references(ref.limit(0), none).count() == 0
    clash = spark.createDataFrame([("a", T(0), None, "z", 5)], PARENTS + ", ref_table string, row_id int")
    assert orphan_references(ref, clash).count() == 0


def test_runs_against_brute_force(spark):
    rng = random.Random(5)
    key = lambda: "hot" if rng.random() < 0.34 else rng.choice([None, *"abcd"])
    parents = [(key(), rng.choice([None, *[T(rng.randrange(200)) for _ in range(5)]]), rng.choice([None, *[T(rng.randrange(200)) for _ in range(9)]])) for _ in range(150)]
    forever = 2**63 - 1
    us = lambda t: int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    want = []
    for k in sorted({k for k, _, _ in parents if k}):
        for s, e in sorted((us(s), us(e) if e else forever) for p, s, e in parents if p == k and s and (e is None or e > s)):
            if want and want[-1][0] == k and s <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(want[-1][2], e))
            else:
                want.append((k, s, e))
    df = spark.createDataFrame(parents, PARENTS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(parent_runs(df)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # over several partitions runs may be cut inside a key, but they cover the same microseconds
    covered = []
    for k, s, e in rows(parent_runs(df)):
        if covered and covered[-1][0] == k and s <= covered[-1][2]:
            covered[-1] = (k, covered[-1][1], max(covered[-1][2], e))
        else:
            covered.append((k, s, e))
    assert covered == want and parent_runs(df.limit(0)).count() == 0
