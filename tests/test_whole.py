"""Queries that must use all rows of their tables, against brute force on small ones."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from replicata.functions.slots import ngram_fingerprint
from replicata.operators import distance, splits
from replicata.queries import modelling


def _embeddings(spark, folder, n, width=3):
    m = np.random.default_rng(7).normal(size=(n, width)).astype(np.float32)
    data = [(i, [float(x) for x in r], i % 3) for i, r in enumerate(m)]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return np.linalg.norm(m.astype(float)[:, None] - m.astype(float)[None], axis=2)


def test_butina_clusters_has_all_rows(spark, tmp_path):
    near = _embeddings(spark, tmp_path, 90) <= 1.25
    cluster, n = {}, 0
    for i in sorted(range(90), key=lambda i: (-near[i].sum(), i)):
        if i not in cluster:
            for j in np.flatnonzero(near[i]):
                cluster.setdefault(int(j), n)
            n += 1
    assert dict(rows(modelling.queries()["butina_clusters"](spark, str(tmp_path)))) == cluster


def test_slices_bound_the_distances(monkeypatch):
    monkeypatch.setattr(distance, "PAIR_VALUES", 12)
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([[float(i), 0.0] for i in range(7)])], ["id", "v"])
    parts = list(distance._slices(b, 5))
    assert [x.tolist() for _, x in parts] == [[0, 1], [2, 3], [4, 5], [6]]
    assert np.vstack([m for m, _ in parts]).tolist() == [[i, 0] for i in range(7)]


def test_domain_trains_on_all_other_rows(spark, tmp_path):
    d, k = _embeddings(spark, tmp_path, 90), 3
    q, t = [i for i in range(90) if i % 20 == 0], [i for i in range(90) if i % 20]
    own = {i: np.sort(d[i, t])[: k + 1].sum() / k for i in t}
    near = {i: sorted(t, key=lambda j: (d[i, j], j))[:k] for i in q}
    mean, std = np.mean(list(own.values())), np.std(list(own.values()))
    z = {i: max((d[i, near[i]].mean() - mean) / std, 1e-6) for i in q}
    density = {i: d[i, near[i]].mean() / np.mean([own[j] for j in near[i]]) for i in q}
    for name, want in (("ad_zscore", z), ("ad_local_density", density)):
        got = dict(rows(modelling.queries()[name](spark, str(tmp_path))))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in q)


def test_importance_has_all_features_and_repeats(spark, monkeypatch):
    from replicata.operators import models

    m = np.random.default_rng(5).normal(size=(40, 5))
    df = spark.createDataFrame([(i, [float(x) for x in r], float(3 * r[1] - r[4])) for i, r in enumerate(m)], "id bigint, features array<double>, y double")
    fitted = models.fit(df, "linear", classification=False)
    got = {r.feature: r for r in models.permutation_importance(fitted, df, "id", seed=3, repeats=4).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and got[1].importance > got[4].importance > 0.1 and all(abs(got[i].importance) < 1e-6 for i in (0, 2, 3))
    # one repeat a pass gives the same, and so does shuffling by hand
    monkeypatch.setattr(models, "PASS_VALUES", 1)
    single = {r.feature: r for r in models.permutation_importance(fitted, df, "id", seed=3, repeats=4).collect()}
    assert all(abs(single[i].importance - got[i].importance) < 1e-9 and abs(single[i].std - got[i].std) < 1e-9 for i in got)
    gains = []
    for rep in range(4):
        order = [r.id for r in df.selectExpr("id", f"xxhash64(id, 3, {rep}) AS h").orderBy("h", "id").collect()]
        x = m[:, 1].copy()
        for i, j in zip(order, order[-1:] + order[:-1], strict=True):
            x[i] = m[j, 1]
        gains.append(np.mean((3 * x - 3 * m[:, 1]) ** 2))
    assert abs(got[1].importance - np.mean(gains)) < 1e-6 and abs(got[1].std - np.std(gains)) < 1e-6


def test_importance_query_has_all_places(spark, tmp_path):
    from replicata.queries import models as registered

    _embeddings(spark, tmp_path, 120)
    assert [r[0] for r in rows(registered.queries()["permutation_importance"](spark, str(tmp_path)).select("feature"))] == [0, 1, 2]


def _sets(rng, n, width, most):
    """Random sets with near copies of themselves, an empty one and ones just at a cutoff of 0.3 (7 of 10 elements shared)."""
    out = [sorted(rng.choice(width, rng.integers(1, most), replace=False).tolist()) for _ in range(n)]
    out += [s[1:] + [width - 1] for s in out[: n // 2]]
    return [*out, [], [], list(range(10)), list(range(7)), list(range(3, 10)), list(range(9))]


@pytest.mark.parametrize("cutoff", [-0.1, 0.0, 0.3, 0.5, 0.99])
def test_near_sets_are_all_found(spark, monkeypatch, cutoff):
    sets = _sets(np.random.default_rng(3), 60, 100, 30)
    df = spark.createDataFrame([*enumerate(sets), (-1, None)], "id bigint, bits array<int>")
    monkeypatch.setattr(distance, "BLOCK_VALUES", 100)  # several blocks of queries
    want = {}
    for i, a in enumerate(map(set, sets)):
        for j, b in enumerate(map(set, sets)):
            d = 1 - len(a & b) / len(a | b) if a | b else 0.0
            if i % 3 == 0 and d <= cutoff:
                want[i, j] = d
    got = rows(distance.tanimoto_pairs(df.filter("id % 3 = 0"), df, 100, cutoff))
    assert len(got) == len(want) and all(want[i, j] == d for i, j, d in got)


def test_few_sets_are_counted_out():
    """Of texts of common pieces nearly no pair is left by its projections, of equal or near texts all."""
    rng = np.random.default_rng(4)
    pieces = ["".join(rng.choice(list("CNOcn1()="), rng.integers(2, 10))) for _ in range(40)]
    sets = np.zeros((2000, 1024), dtype=np.uint8)
    for i in range(1000):
        t = "".join(rng.choice(pieces, 13))
        sets[i, [sum(ord(x) * m for x, m in zip(t[k : k + 3], (1, 131, 17161), strict=True)) % 1024 for k in range(len(t) - 2)]] = 1
    sets[1000:] = sets[:1000]
    sets[1000:, 5] ^= 1
    axes, n = distance._axes(sets), sets.sum(axis=1)
    assert axes.shape == (1024, distance.AXES) and np.allclose(axes.T @ axes, np.eye(distance.AXES), atol=1e-5)
    assert distance._axes(sets[:, :8]).shape == (8, 8)
    p = sets.astype(np.float32) @ axes
    apart = ((p[:, None, :] - p[None, :200]) ** 2).sum(axis=2)
    may = apart <= 0.3 / 1.7 * (n[:, None] + n[None, :200]) + 0.25
    assert may[np.arange(200), np.arange(200)].all() and may[np.arange(200) + 1000, np.arange(200)].all() and may.mean() < 0.02


def test_structures_are_compared_once(spark, monkeypatch):
    """The masks are those of all pairs of rows, but rows of one structure are not paired: 900 rows of it make one query and one row."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("CNOcn1"), 30)) for _ in range(12)]
    texts += [t[:-1] + "S" for t in texts] + ["", " ", None]
    data = [(i, i % 7, texts[i % len(texts)]) for i in range(300)] + [(i, i % 4, "CCCCCCOCCCC") for i in range(300, 1200)] + [(1220, 5, "unlike all"), (1221, None, texts[0])]
    df = spark.createDataFrame(data, "id bigint, g int, s string")
    asked = F.col("id") % 20 == 0
    whole = df.select("id", ngram_fingerprint(F.col("s")).alias("bits"))
    pairs = distance.tanimoto_pairs(whole.filter(asked), whole, cutoff=1.0).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "distance")
    want = rows(splits.near_masks(pairs, df, "id", "g", 0.3))
    compared, pair_up = [], distance.tanimoto_pairs

    def counted(queries, others, **more):
        compared.append((queries.count(), others.count()))
        return pair_up(queries, others, **more)

    monkeypatch.setattr(distance, "tanimoto_pairs", counted)
    got = rows(splits.structure_masks(df, "id", "g", "s", asked, ngram_fingerprint, 0.3))
    # a row without neighbours has an empty list
    assert got == want and (5, [], 1) in got
    kinds = {s for _, _, s in data if s is not None}
    assert compared == [(len({s for i, _, s in data if i % 20 == 0 and s is not None}), len(kinds))]


@pytest.mark.parametrize("cutoff", [0.3, 0.99])
def test_near_queries_are_found_from_both_sides(spark, monkeypatch, cutoff):
    """Pairs of queries are compared once; pairs and rows are the same as without that, in several blocks and tiles."""
    sets = _sets(np.random.default_rng(5), 60, 100, 30)
    df = spark.createDataFrame([(997 * i % 101, s, i % 3 != 0) for i, s in enumerate(sets)] + [(-1, None, True)], "id bigint, bits array<int>, asked boolean")
    monkeypatch.setattr(distance, "BLOCK_VALUES", 100)
    monkeypatch.setattr(distance, "TILE", 8)
    for few in (df, df.filter("asked")):
        got = rows(distance.tanimoto_pairs(df.filter("asked"), few, 100, cutoff, both="asked"))
        assert got == rows(distance.tanimoto_pairs(df.filter("asked"), few, 100, cutoff)) and any(a > b for a, b, _ in got)


def test_genetic_split_asks_all_records(spark, tmp_path):
    """The far fractions count every record: those of the split are the ones that plain Python finds, in a table without any id divisible by 20."""
    import __spark_entry__ as registered

    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("CNOcn1"), 30)) for _ in range(40)]
    texts += [t[:-1] + "S" for t in texts] + ["", None]
    data = [(20 * i + 1 + i % 19, f"s{i % 11}", texts[int(rng.integers(len(texts)))], float(rng.random()), int(i % 2)) for i in range(230)]
    df = spark.createDataFrame(data, "rec_id bigint, series_id string, base_rdkit_smiles string, pic50 double, active int")
    df.write.parquet(str(tmp_path / "htr3a_dtc_smiles_curated.parquet"))
    split = {r.group: r for r in registered.queries()["genetic_split"](spark, str(tmp_path)).collect()}
    group = {r.group: r.super_group for r in splits.smush(df, "series_id", 100).collect()}
    bits = {r.s: set(r.b) for r in df.select(F.col("base_rdkit_smiles").alias("s"), ngram_fingerprint(F.col("base_rdkit_smiles")).alias("b")).filter("s is not null").distinct().collect()}
    of = [(split[group[g]].subset, bits[s]) for _, g, s, _, _ in data if s is not None]
    train = [b for subset, b in of if subset == "train"]
    for part in ("valid", "test"):
        mine = [b for subset, b in of if subset == part]
        far = sum(not any((1 - len(a & b) / len(a | b) if a | b else 0.0) < 0.3 for b in train) for a in mine) / len(mine)
        assert abs(split[0][f"far_{part}"] - far) < 1e-6 and 0 < far < 1
