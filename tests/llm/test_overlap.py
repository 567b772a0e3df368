import random

from conftest import rows
from replicata.llm.overlap import near_texts, overlap_pairs, overlap_records


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _edit(rng, s, n):
    for _ in range(n):
        i, c = rng.randrange(len(s) + 1), rng.choice("abc(=1")
        s = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])
    return s


def test_no_pair_within_the_distance_is_lost(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abc(=1") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 20, 40]))) for _ in range(60)]
    texts = sorted({*base, *[_edit(rng, s, rng.randrange(4)) for s in base], *[_edit(rng, s, rng.randrange(3)) for s in base], *[s * 3 for s in base[:9]]})
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    for d in (0, 1, 2, 3):
        want = {frozenset((i, j)): _distance(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if abs(len(a) - len(b)) <= d and _distance(a, b) <= d}

        def got(**more):
            found = near_texts(df, d, **more).collect()
            assert len(found) == len({frozenset((r.a, r.b)) for r in found})
            return {frozenset((r.a, r.b)): r.distance for r in found}

        assert got() == want
        # every n-gram with more than five pairs counts as heavy: short texts meet by what deletions leave, longer ones over many tasks
        if d == 2:
            assert got(heavy_pairs=5) == want
            assert got(heavy_pairs=5, short=20) == want


def test_containment(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "abcdefg"), (3, "x"), (4, "")], "id bigint, text string")
    got = {(r.a, r.b): (r.a_in_b, r.b_in_a) for r in near_texts(df, 1).collect()}
    assert got == {(2, 1): (0.8, 1.0), (4, 3): (0.0, 0.0)}


def test_pairs_of_rows(spark):
    r = spark.createDataFrame([(1, "s", 0, "train", "a"), (2, "s", 0, "test", "a"), (3, "s", 0, "valid", "b"), (4, "s", 1, "test", "a"), (5, "s", 0, "train", "c"), (6, "s", 0, None, "a"), (7, "s", 0, "test", None), (8, "s", 0, "test", "a")], "row_id bigint, split_uuid string, fold int, subset string, key string")
    texts = spark.createDataFrame([("a", "abcdefghij"), ("b", "abcdXfghij"), ("c", "zzzzzzzzzz"), ("b", None), (None, "x"), ("a", "abcdefghij")], "key string, text string")
    assert rows(overlap_pairs(r, texts)) == [(1, 2), (1, 3), (1, 8)]
    assert overlap_pairs(r.limit(0), texts).count() == 0
    assert rows(overlap_pairs(r, texts.limit(0))) == [(1, 2), (1, 8)]


def test_records(spark):
    # key a has two structures, of which the second is nearer to b; c has the structure of a; hot keys are dealt
    rows_ = [(1, "s", 0, "train", "a"), (2, "s", 0, "test", "b"), (3, "s", 0, "test", "c"), (4, "s", 0, "valid", "a"), (5, "s", 0, "train", "a")]
    r = spark.createDataFrame([(*x, "z") for x in rows_], "row_id bigint, split_uuid string, fold int, subset string, key string, text string")
    texts = spark.createDataFrame([("a", "abcdefghij"), ("a", "abcdefghXX"), ("b", "abcdefghXi"), ("c", "abcdefghij")], "key string, text string")
    want = [*[(2, i, False, 1, 7 / 8) for i in (1, 5)], *[(3, i, False, 0, 1.0) for i in (1, 5)], *[(4, i, True, 0, 1.0) for i in (1, 5)]]
    assert rows(overlap_records(r, texts)) == want
    assert rows(overlap_records(r, texts, heavy_pairs=1)) == want
