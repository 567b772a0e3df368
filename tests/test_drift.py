import datetime as dt
import json
import random
from itertools import permutations

import numpy as np

from conftest import rows
from replicata.operators import drift

FILES = "series_id bigint, file_id bigint, written_at timestamp_ntz, body string, family string"


def _at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def _changes(spark, *files):
    df = spark.createDataFrame([(s, i, _at(n) if n is not None else None, b if b is None or isinstance(b, str) else json.dumps(b), "f") for s, i, n, b in files], FILES)
    return rows(drift.schema_changes(df))


def test_every_kind_of_change(spark):
    got = _changes(spark, (1, 1, 0, {"a": "1", "b": 2, "c": True, "o": {"x": 1}, "comment": "z"}), (1, 2, 1, {"A": "1", "b": "2", "o": {"y": 1}, "d": None}), (2, 3, 0, {"q": 1}))
    assert got == [(1, 2, "added", "d", ""), (1, 2, "removed", "c", ""), (1, 2, "renamed", "a", "A"), (1, 2, "renamed", "o.x", "o.y"), (1, 2, "retyped", "b", "")]


def test_null_broken_and_repeated(spark):
    got = _changes(spark, (1, 1, 0, {"a": 1}), (1, 2, 1, "{broken"), (1, 3, 2, None), (1, 4, 3, {"a": None}), (1, 5, 4, {"a": "x"}), (1, 5, 4, {"a": "x"}), (None, 6, 0, {"a": 1}), (1, 7, None, {"b": 5, "a": 1}))
    # the file without a time comes first; null types are never retyped
    assert got == [(1, 1, "removed", "b", "")]


def test_names_decide_among_equal_values(spark):
    got = _changes(spark, (1, 1, 0, {"save_results": "False", "datastore": "False"}), (1, 2, 1, {"dataStore": "False", "saveResults": "False"}))
    assert got == [(1, 2, "renamed", "datastore", "dataStore"), (1, 2, "renamed", "save_results", "saveResults")]


def test_long_series_over_many_partitions(spark):
    rng = random.Random(1)
    files, want, state = [], [], {f"k{i}": i for i in range(6)}
    for n in range(400):
        files.append((7 if n % 3 else 7, n, n, dict(state)))
        k = rng.choice(sorted(state))
        v = state.pop(k)
        new = f"n{n}"
        state[new] = v
        want.append((7, n + 1, "renamed", k, new))
    assert _changes(spark, *files) == sorted(want[:-1])


def test_empty(spark):
    assert drift.schema_changes(spark.createDataFrame([], FILES)).count() == 0


def test_assignment_is_best():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n, m = rng.integers(1, 5, 2)
        w = np.where(rng.random((n, m)) < 0.2, -np.inf, rng.random((n, m)))
        got = drift.assign(w)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        best = (0, 0.0)
        rows_, cols = (range(n), range(m)) if n <= m else (range(m), range(n))
        a = w if n <= m else w.T
        for p in permutations(cols, len(rows_)):
            pairs = [a[i, j] for i, j in zip(rows_, p, strict=True) if np.isfinite(a[i, j])]
            best = max(best, (len(pairs), sum(pairs)))
        assert len(got) == best[0]
        assert abs(sum(w[i, j] for i, j in got) - best[1]) < 1e-9


def test_unified_table(spark):
    files = [(1, 1, _at(0), '{"epochs": "5", "l": ["64,32"]}', "f"), (1, 2, _at(1), '{"max_epochs": "5", "l": ["64,32"]}', "f"), (1, 3, _at(2), '{"max_epochs": 7}', "f"), (1, 4, _at(3), "nope", "f")]
    got = drift.unified_table(spark.createDataFrame(files, FILES), ["max_epochs", "l"]).select("file_id", "max_epochs", "l")
    assert sorted((r.file_id, r.max_epochs, r.l) for r in got.collect()) == [(1, ["5"], ["64,32"]), (2, ["5"], ["64,32"]), (3, ["7"], None)]


def test_unified_values_stay_as_written(spark):
    body = '{"a": "Smith, John", "b": "[draft]", "c": [1, 2.50, "x, y", null], "d": 1.0e3, "e": true, "f": null, "g": [], "o": {"p": "True"}}'
    got = drift.unified_table(spark.createDataFrame([(1, 1, _at(0), body, "f"), (None, 2, None, "{}", None), (3, 3, _at(0), "[1]", "")], FILES), ["a", "b"])
    seen = {r.file_id: (r.a, r.b, r.others, r.conflicts) for r in got.collect()}
    assert seen[1] == (["Smith, John"], ["[draft]"], {"c": ["1", "2.50", "x, y", "null"], "d": ["1.0e3"], "e": ["true"], "f": None, "g": [], "o.p": ["True"]}, [])
    assert seen[2] == seen[3] == (None, None, {}, [])


def test_unified_scope_and_accidents(spark):
    files = [
        # in family f a is renamed to b, in family g they are two things, which once swapped by equal values
        *[(1, i, _at(i), json.dumps({("a" if i < 3 else "b"): "v", "k": i}), "f") for i in range(5)],
        *[(2, 10 + i, _at(i), json.dumps({"a": "v", "b": "w", "k": i}), "g") for i in range(5)],
        (2, 15, _at(5), '{"a": "v", "k": 1}', "g"), (2, 16, _at(6), '{"b": "v", "k": 1}', "g"),
        (4, 17, _at(0), '{"a": "y", "b": "z"}', "f"),
    ]
    got = {r.file_id: r for r in drift.unified_table(spark.createDataFrame(files, FILES), ["a"]).collect()}
    assert all(got[i].a == ["v"] and set(got[i].others) == {"k"} for i in range(5))
    assert got[10].a == ["v"] and got[10].others == {"b": ["w"], "k": ["0"]} and got[16].a is None and got[16].others == {"b": ["v"], "k": ["1"]}
    # of two fields of one name the canonical one wins and the other is reported
    assert got[17].a == ["y"] and got[17].others == {"b": ["z"]} and got[17].conflicts == ["b"] and got[10].conflicts == []


def test_profile(spark):
    p = drift.field_profile(drift.file_fields(spark.createDataFrame([(1, 1, _at(0), '{"a": 1, "b": null}', "f"), (1, 2, _at(0), '{"a": "x"}', "f")], FILES)))
    assert {r.field: (r.n_files, r.n_number, r.n_text, r.n_null) for r in p.collect()} == {"a": (2, 1, 1, 0), "b": (1, 0, 0, 1)}


def test_unified_table_keeps_every_field(spark):
    files = [(1, 1, _at(0), '{"epochs": "5", "seed": 3, "note": null}', "f"), (1, 2, _at(1), '{"max_epochs": "5", "seed": 3}', "f"), (1, 3, _at(2), '{"max_epochs": 7, "epochs": 8, "seed": 4}', "f"), (1, 4, _at(3), '{"max_epochs": 7}', "f")]
    got = drift.unified_table(spark.createDataFrame(files, FILES), ["max_epochs"])
    seen = {r.file_id: (r.max_epochs, r.others) for r in got.collect()}
    assert seen == {1: (["5"], {"seed": ["3"], "note": None}), 2: (["5"], {"seed": ["3"]}), 3: (["7"], {"seed": ["4"], "epochs": ["8"]}), 4: (["7"], {})}
