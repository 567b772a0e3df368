"""Splits into train, valid and test, and how good they are (SPL)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicata.functions.keys import hash60
from replicata.operators.joins import with_ordinal

SUBSETS = ("train", "valid", "test")


def by_fraction(position: Column, total: Column, valid: float, test: float) -> Column:
    """Subset of a row by its position (from 0) among ``total``: the first rows train, then valid, then test; counts are rounded down for train and valid."""
    train = F.floor(total * F.lit(1.0 - valid - test) + F.lit(1e-9))
    upto = F.floor(total * F.lit(1.0 - test) + F.lit(1e-9))
    return F.when(position < train, "train").when(position < upto, "valid").otherwise("test")


def index_split(df: DataFrame, order: str, valid: float, test: float) -> DataFrame:
    """SPL4: by the order of a unique column."""
    return _place(with_ordinal(df, order), valid, test)


def random_split(df: DataFrame, key: str, valid: float, test: float, seed: int) -> DataFrame:
    """SPL4: exact fractions in the order of a hash of the key and the seed; the same on every run and partitioning."""
    return _place(with_ordinal(df.withColumn("_h", hash60(F.col(key), F.lit(seed))), "_h", key).drop("_h"), valid, test)


def _place(df: DataFrame, valid: float, test: float) -> DataFrame:
    n = df.agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(n)).withColumn("subset", by_fraction(F.col("ordinal"), F.col("_n"), valid, test)).drop("_n", "ordinal")


def stratified_split(df: DataFrame, order: str, label: str, valid: float, test: float) -> DataFrame:
    """SPL4: the fractions hold inside each class; missing labels are a class of their own.

    Positions in a class are running counts over a range-sorted table, so a class may hold any share of the rows.
    """
    from replicata.plans.range_scan import running_sums

    placed = running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), [label], [F.col(order)], {"_k": "_one"})
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    a, b = placed.alias("a"), n.alias("b")
    return a.join(b, F.col(f"a.{label}").eqNullSafe(F.col(f"b.{label}"))).select(*[f"a.{c}" for c in df.columns], by_fraction(F.col("_k") - 1, F.col("_n"), valid, test).alias("subset"))


def kfold(df: DataFrame, number: Column, folds: int) -> DataFrame:
    """SPL2: one row per fold and row: ``valid`` in the fold of its number, else ``train``."""
    own = F.pmod(number, F.lit(folds)).cast("int")
    return df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("subset", F.when(F.col("fold") == own, "valid").otherwise("train"))


def kfold_split(df: DataFrame, order: str, test: float, folds: int) -> DataFrame:
    """SPL2: the last rows by ``order``, in the share ``test``, are test in every fold; the others are valid in one fold and train in the rest."""
    held = index_split(df, order, 0.0, test)
    number = F.xxhash64(F.col(order))
    rest = kfold(held.filter("subset = 'train'").drop("subset"), number, folds)
    last = held.filter("subset = 'test'").drop("subset").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("subset", F.lit("test"))
    return rest.unionByName(last)


def cluster_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """SPL2: adds ``fold``: whole groups are dealt to folds, the largest first, each to the fold with the fewest rows."""
    return _join_groups(df, group, smush(df, group, folds).withColumnRenamed("super_group", "fold"), "n")


def split_with(df: DataFrame, splitter: str, key: str, group: str | None = None, valid: float = 0.1, test: float = 0.1, seed: int = 0, **more) -> DataFrame:
    """SPL1, SPL12: a frame split by the name of a splitter: index, random, scaffold, stratified, temporal, production, k_fold_cv."""
    ways = {
        "index": lambda: index_split(df, key, valid, test),
        "random": lambda: random_split(df, key, valid, test, seed),
        "scaffold": lambda: scaffold_split(df, group or key, valid, test),
        "stratified": lambda: stratified_split(df, key, group or key, valid, test),
        "temporal": lambda: temporal_split(df, more["date"], more["cutoff"], key, valid),
        "production": lambda: production_split(df),
        "k_fold_cv": lambda: kfold_split(df, key, test, more.get("folds", 5)),
    }
    if splitter not in ways:
        raise ValueError(f"unknown splitter {splitter}")
    return ways[splitter]()


def production_split(df: DataFrame) -> DataFrame:
    """SPL3: every row in all three subsets."""
    return df.withColumn("subset", F.explode(F.array(*[F.lit(s) for s in SUBSETS])))


def temporal_split(df: DataFrame, date: str, cutoff: object, order: str, valid: float) -> DataFrame:
    """SPL6: rows after the cutoff are test; of the others (missing dates too) the last by ``order`` are valid, in the share ``valid``."""
    late = F.coalesce(F.col(date) > F.lit(cutoff), F.lit(False))
    return index_split(df.filter(~late), order, valid, 0.0).unionByName(df.filter(late).withColumn("subset", F.lit("test")))


def _ranked_groups(df: DataFrame, group: str) -> tuple[DataFrame, list]:
    """Groups with size ``n`` and rank from 1 among those of their size by name, and how many groups there are of each size, largest first.

    N rows have at most the root of 2 N different sizes, which is all that goes to the driver.
    """
    from replicata.plans.range_scan import running_sums
    from replicata.plans.storage import materialize

    sizes = materialize(df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n")).withColumn("_one", F.lit(1).cast("bigint")))
    ranked = running_sums(sizes, ["n"], [F.col("group").asc_nulls_first()], {"rank": "_one"}).drop("_one")
    return ranked, sorted(sizes.groupBy("n").agg(F.count("*").alias("c")).collect(), key=lambda r: -r.n)


def _join_groups(df: DataFrame, group: str, per_group: DataFrame, n: str) -> DataFrame:
    """``df`` with the row of its group, also the missing one; a group of very many rows is dealt to several tasks."""
    from replicata.plans.skew import join_per_key

    keys = {"_gnull": F.col(group).isNull(), "_gkey": F.coalesce(F.col(group).cast("string"), F.lit(""))}
    own = {"_gnull": F.col("group").isNull(), "_gkey": F.coalesce(F.col("group").cast("string"), F.lit(""))}
    return join_per_key(df.withColumns(keys), per_group.withColumns(own).drop("group"), ["_gnull", "_gkey"], n).drop("_gnull", "_gkey")


def scaffold_split(df: DataFrame, group: str, valid: float, test: float) -> DataFrame:
    """SPL5: whole groups, largest first (ties: the smaller name), fill train while it has room, then valid, then test.

    Groups of one size differ by name only, so the greedy fill is decided per size on the driver and groups find their subset by their rank
    among those of their size.  A missing group is a group and comes first among equals.
    """
    ranked, sizes = _ranked_groups(df, group)
    total = sum(r.n * r.c for r in sizes)
    room, got, rows = ((1 - valid - test) * total, (1 - test) * total), [0, 0], []
    for r in sizes:
        train = max(0, min(r.c, int((room[0] + 1e-9 - got[0]) // r.n)))
        got[0] += train * r.n
        both = max(0, min(r.c - train, int((room[1] + 1e-9 - got[0] - got[1]) // r.n)))
        got[1] += both * r.n
        rows.append((r.n, train, train + both))
    borders = df.sparkSession.createDataFrame(rows, "n bigint, _train bigint, _valid bigint")
    subset = F.when(F.col("rank") <= F.col("_train"), "train").when(F.col("rank") <= F.col("_valid"), "valid").otherwise("test")
    return _join_groups(df, group, ranked.join(borders, "n").select("group", "n", subset.alias("subset")), "n")


def expand_selection(rows: DataFrame, key: str, selected: DataFrame) -> DataFrame:
    """SPL0: all rows whose key was selected after compaction."""
    return rows.join(selected.select(key), key, "left_semi")


def presplit_folds(split: DataFrame, fold: int) -> DataFrame:
    """SPL11: rows of one fold of a k-fold table: its train_valid rows of that fold are valid, others train; test stays."""
    s = F.when(F.col("subset") == "test", "test").when(F.col("fold") == fold, "valid").otherwise("train")
    return split.withColumn("subset", s)


def _deal(load: np.ndarray, size: int, count: int) -> np.ndarray:
    """How many of ``count`` items of one size each heap gets when every item goes to the least loaded heap (ties: the lower number)."""
    low, high = int(load.min()), int(load.min()) + size * (count + 1)

    def upto(level: int) -> np.ndarray:
        """Items that heaps loaded less than ``level`` take before they reach it."""
        return np.maximum(0, -(-(level - load) // size))

    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if upto(mid).sum() < count else (low, mid)
    got = upto(low - 1)
    # The rest goes to heaps that stand at the level, by number.
    for i in np.flatnonzero(load + got * size == low - 1)[: count - int(got.sum())]:
        got[i] += 1
    return got


def smush(df: DataFrame, group: str, most: int) -> DataFrame:
    """SPL9: at most ``most`` super-groups: groups by falling size are dealt to the super-group with the fewest rows (ties: the lower number).

    Groups of one size differ by name only: how many of them each super-group gets is decided on the driver from the counts of sizes, and they are dealt by
    name, the lowest super-group first.  A missing group is a group.  Returns ``group, super_group, n``.
    """
    ranked, sizes = _ranked_groups(df, group)
    load, rows = np.zeros(most, dtype=np.int64), []
    for r in sizes:
        got = _deal(load, r.n, r.c)
        load += got * r.n
        ends = np.cumsum(got)
        rows += [(r.n, int(s), int(ends[s] - got[s]), int(ends[s])) for s in np.flatnonzero(got)]
    cuts = df.sparkSession.createDataFrame(rows, "n bigint, super_group int, _after bigint, _upto bigint")
    per_size = cuts.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("_upto", "super_group"))).alias("_cuts"))
    found = F.get(F.filter("_cuts", lambda c: c["_upto"] >= F.col("rank")), F.lit(0))["super_group"]
    return ranked.join(per_size, "n").select("group", found.alias("super_group"), "n")


# Fitness of a split


def far_fraction(pairs: DataFrame, members: DataFrame, key: str, cutoff: float) -> DataFrame:
    """SPL9a: per subset other than train the share of its keys without a train neighbour nearer than the cutoff.

    ``pairs``: ``a, b, distance`` with ``a`` the keys asked about; ``members``: key and ``subset``.
    """
    near = pairs.filter(F.col("distance") < cutoff).join(members.filter("subset = 'train'").select(F.col(key).alias("b")), "b").select("a").distinct()
    rest = members.filter("subset <> 'train'")
    return rest.join(near.withColumn("near", F.lit(1)), rest[key] == near["a"], "left").groupBy("subset").agg(F.count("*").alias("n"), (1 - F.count("near") / F.count("*")).alias("far_fraction"))


def ratio_fitness(df: DataFrame, tasks: list[str], wanted: dict[str, float]) -> DataFrame:
    """SPL9b: one row ``fitness``: 1 - distance of the least, median and largest task share of each subset from the wanted one, over 3; 0 if a share is 0."""
    have = df.groupBy("subset").agg(*[F.count(t).cast("double").alias(t) for t in tasks])
    total = df.filter(F.col("subset").isin(list(wanted))).agg(*[F.count(t).cast("double").alias(f"_{t}") for t in tasks])
    shares = have.filter(F.col("subset").isin(list(wanted))).crossJoin(F.broadcast(total)).select("subset", F.array_sort(F.array(*[F.coalesce(F.try_divide(F.col(t), F.col(f"_{t}")), F.lit(0.0)) for t in tasks])).alias("s"))
    mid = (len(tasks) - 1) // 2
    median = F.element_at("s", mid + 1) if len(tasks) % 2 else (F.element_at("s", mid + 1) + F.element_at("s", mid + 2)) / 2
    w = F.element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("subset"))
    sq = sum(F.pow(w - c, F.lit(2.0)) for c in (F.element_at("s", 1), median, F.element_at("s", len(tasks))))
    g = shares.agg(F.sum(sq).alias("d"), F.min(F.element_at("s", 1)).alias("least"), F.count("*").alias("n"))
    return g.select(F.when((F.col("least") == 0) | (F.col("n") < len(wanted)), 0.0).otherwise(1 - F.sqrt("d") / 3).alias("fitness"))


def response_fitness(df: DataFrame, tasks: list[str]) -> float:
    """SPL9c: 1 - mean Wasserstein distance of each task's test and valid responses from train; 0 if a task misses a subset."""
    from replicata.operators.metrics import wasserstein

    found = [wasserstein(df, t, "subset", "train", s).first().distance for t in tasks for s in ("valid", "test")]
    return 0.0 if any(x is None for x in found) else 1 - float(np.mean(found))


def group_min_distance(pairs: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """SPL9d: the least distance between rows of two groups: ``group_a < group_b, distance``."""
    a, b = groups.select(F.col(key).alias("a"), F.col(group).alias("ga")), groups.select(F.col(key).alias("b"), F.col(group).alias("gb"))
    j = pairs.join(a, "a").join(b, "b").filter("ga <> gb")
    return j.groupBy(F.least("ga", "gb").alias("group_a"), F.greatest("ga", "gb").alias("group_b")).agg(F.min("distance").alias("distance"))


def ave_bias(nearest: DataFrame) -> DataFrame:
    """SPL7: one row ``bias`` of a split from the distances of its validation rows to the nearest training active and inactive.

    ``nearest``: ``active`` (0 or 1), ``to_active, to_inactive``.  The bias is the mean over thresholds 0, 0.01 .. 1 of
    P(to same class <= t) - P(to other class <= t), for actives plus inactives.
    """
    same = F.when(F.col("active") == 1, F.col("to_active")).otherwise(F.col("to_inactive"))
    other = F.when(F.col("active") == 1, F.col("to_inactive")).otherwise(F.col("to_active"))

    def share(c: Column) -> Column:
        """Of the thresholds, the part that is at least ``c``, as the mean of the step function over them."""
        return F.greatest(F.lit(101) - F.ceil(F.greatest(c, F.lit(0.0)) * 100 - F.lit(1e-9)), F.lit(0)) / 101

    per = nearest.groupBy("active").agg(F.avg(share(same) - share(other)).alias("d"))
    return per.agg(F.sum("d").alias("bias"))


# Genetic search: chromosomes on the driver, their fitness from small tables or distributed passes


def evolve(start: np.ndarray, fitness: Callable[[np.ndarray], np.ndarray], mutate: Callable, crossover: Callable, generations: int, seed: int, keep: int = 1) -> tuple[np.ndarray, float]:
    """SPL10: the fittest chromosome after some generations: the better half are parents, the best ``keep`` live on unchanged.

    ``fitness`` grades a whole population at once, so that one distributed pass can serve a generation.
    """
    rng = np.random.default_rng(seed)
    pop = start.copy()
    scores = np.asarray(fitness(pop))
    for _ in range(generations):
        order = np.argsort(-scores, kind="stable")
        parents = pop[order[: max(2, len(pop) // 2)]]
        young = [mutate(crossover(*parents[rng.choice(len(parents), 2, replace=False)], rng), rng) for _ in range(len(pop) - keep)]
        pop = np.vstack([pop[order[:keep]], *[np.asarray(y)[None, :] for y in young]])
        scores = np.asarray(fitness(pop))
    best = int(np.argmax(scores))
    return pop[best], float(scores[best])


def group_histogram(df: DataFrame, group: str, tasks: list[str], bins: int = 64) -> DataFrame:
    """``group, task, bin, n``: responses per group and task in ``bins`` equal steps between the task's least and largest; missing ones are left out.

    Bounded by groups, tasks and bins, whatever the number of rows.
    """
    x = df.select(F.col(group).alias("group"), F.explode(F.array(*[F.struct(F.lit(i).alias("task"), F.col(t).cast("double").alias("v")) for i, t in enumerate(tasks)])).alias("r")).select("group", "r.*")
    x = x.filter("v is not null and not isnan(v) and abs(v) <> double('inf')")
    ends = x.groupBy("task").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return x.join(F.broadcast(ends), "task").groupBy("group", "task", step.alias("bin")).agg(F.count("*").alias("n"))


def near_masks(pairs: DataFrame, members: DataFrame, key: str, group: str, cutoff: float) -> DataFrame:
    """``group, near, n``: how many asked keys of a group have neighbours nearer than ``cutoff`` in just the groups of the list ``near``.

    ``pairs``: ``a, b, distance``, ``a`` the keys asked about; ``members``: key and group; a key is no neighbour of itself.
    """
    of = members.select(F.col(key).alias("k"), F.col(group).alias("g"))
    asked = pairs.select("a").distinct().join(of.withColumnsRenamed({"k": "a", "g": "group"}), "a")
    close = pairs.filter((F.col("distance") < cutoff) & (F.col("a") != F.col("b"))).join(of.withColumnsRenamed({"k": "b", "g": "h"}), "b").groupBy("a").agg(F.array_sort(F.collect_set("h")).alias("near"))
    return asked.join(close, "a", "left").groupBy("group", F.coalesce("near", F.array().cast("array<int>")).alias("near")).agg(F.count("*").alias("n"))


def structure_masks(rows: DataFrame, key: str, group: str, structure: str, asked: Column, prints: Callable[[Column], Column], cutoff: float) -> DataFrame:
    """:func:`near_masks` of the rows for which ``asked`` holds against all rows, by the Tanimoto distance of the fingerprints that ``prints`` gives for structures.

    Rows of equal structure have the same neighbours, so each different structure is compared once (two asked ones for both directions) and pairs of rows are never made: a structure knows, for every group
    near it, the least and largest key, which tell whether a row other than the asked one is there.  ``key`` tells rows apart; rows without a structure are left out.
    ``rows`` is read twice and should be a written table.
    """
    from replicata.operators.distance import tanimoto_pairs
    from replicata.plans.skew import join_per_key
    from replicata.plans.storage import materialize, spread

    of = rows.select(F.col(key).alias("k"), F.col(group).alias("group"), F.col(structure).alias("s"), F.coalesce(asked, F.lit(False)).alias("asked")).filter("s is not null")
    held = of.groupBy("s", "group").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count_if("asked").alias("n"))
    kinds = materialize(held.groupBy("s").agg(F.collect_list(F.struct("group", "lo", "hi")).alias("held"), F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    sets = materialize(spread(kinds.select("id", "s", "n")).select("id", "n", prints(F.col("s")).alias("bits")))
    pairs = tanimoto_pairs(sets.filter("n > 0"), sets.withColumn("both", F.col("n") > 0), cutoff=cutoff, both="both").filter(F.col("distance") < cutoff)
    near = pairs.join(kinds.select("id", "held"), "id").select("query_id", F.inline("held")).filter("group is not null").groupBy("query_id", "group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = near.groupBy(F.col("query_id").alias("id")).agg(F.collect_list(F.struct("group", "lo", "hi")).alias("found"))
    per = materialize(kinds.filter("n > 0").select("id", "s", "n").join(found, "id", "left").select("s", "n", "found"))
    own = join_per_key(of.filter("asked").select("k", "group", "s"), per, ["s"], "n")
    others = F.filter("found", lambda f: (f["lo"] != F.col("k")) | (f["hi"] != F.col("k")))
    return own.groupBy("group", F.coalesce(F.sort_array(F.transform(others, lambda f: f["group"])), F.array().cast("array<int>")).alias("near")).agg(F.count("*").alias("n"))


def _far_fractions(masks: DataFrame, groups: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function of a population (rows: chromosomes of 0 train, 1 valid, 2 test) that gives the far fractions of valid and test: one distributed pass."""
    schema = "chromosome int, part int, n bigint, far bigint"

    def grade(population: np.ndarray) -> np.ndarray:
        shared = masks.sparkSession.sparkContext.broadcast(population)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pop = shared.value
            total = np.zeros((len(pop), 2, 2), dtype=np.int64)
            for b in batches:
                own, n = b.column("group").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)
                near = b.column("near")
                at = np.repeat(np.arange(len(own)), pc.list_value_length(near).to_numpy(zero_copy_only=False))
                hot = np.zeros((len(own), groups), dtype=np.float32)
                hot[at, pc.list_flatten(near).to_numpy(zero_copy_only=False)] = 1
                # By row and chromosome: its subset, and whether no group near it is in train.
                of, far = pop.T[own], hot @ (pop.T == 0).astype(np.float32) == 0
                for part in (1, 2):
                    total[:, part - 1, 0] += n @ (of == part)
                    total[:, part - 1, 1] += n @ ((of == part) & far)
            c, p = np.indices(total.shape[:2])
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel().astype(np.int32)), pa.array(p.ravel().astype(np.int32)), pa.array(total[:, :, 0].ravel()), pa.array(total[:, :, 1].ravel())], ["chromosome", "part", "n", "far"])

        out = np.zeros((len(population), 2))
        for r in masks.select("group", "near", "n").mapInArrow(run, schema).groupBy("chromosome", "part").agg(F.sum("n").alias("n"), F.sum("far").alias("far")).collect():
            out[r.chromosome, r.part] = r.far / r.n if r.n else 0.0
        return out

    return grade


def genetic_group_split(histogram: DataFrame, n_groups: int, n_tasks: int, wanted: tuple[float, float, float] = (0.8, 0.1, 0.1), masks: DataFrame | None = None, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0), generations: int = 30, population: int = 60, seed: int = 0) -> DataFrame:
    """SPL9: ``group, subset`` and the terms of the best split's fitness: super-groups 0 .. ``n_groups`` - 1 dealt to train, valid and test.

    The fitness is the mean, by ``weights``, of the far fractions of test and of valid (:func:`near_masks`; without masks their weight is 0), of how near
    every task's shares come to the ``wanted`` ones, and of how alike the responses of the subsets are (1 - mean Wasserstein distance of
    valid and test from train over the histogram's bins); it is 0 if a task misses a subset.  ``histogram`` comes from :func:`group_histogram` and is
    all that goes to the driver: groups x tasks x bins numbers.  Far fractions are graded in Spark, one pass for a whole generation.
    The start is greedy: each group to the subset that is filled least.  Equal seeds give equal splits.
    """
    rows = histogram.filter(F.col("group").between(0, n_groups - 1)).collect()
    bins = 1 + max((r.bin for r in rows), default=0)
    h = np.zeros((n_groups, n_tasks, bins))
    for r in rows:
        h[r.group, r.task, r.bin] += r.n
    want, total = np.array(wanted), np.maximum(h.sum((0, 2)), 1)
    far_of = _far_fractions(masks, n_groups) if masks is not None else None
    w = np.array(weights) * (1 if masks is not None else np.array([0, 0, 1, 1]))

    def terms(pop: np.ndarray) -> np.ndarray:
        out = np.zeros((len(pop), 4))
        if far_of:
            out[:, [1, 0]] = far_of(pop)
        for i, c in enumerate(pop):
            part = np.stack([h[c == k].sum(0) for k in range(3)])
            share = part.sum(2) / total
            if (share == 0).any():
                continue
            three = np.stack([share.min(1), np.median(share, axis=1), share.max(1)], axis=1)
            out[i, 2] = 1 - float(np.sqrt(((want[:, None] - three) ** 2).sum())) / 3
            cdf = np.cumsum(part, axis=2) / part.sum(2, keepdims=True)
            out[i, 3] = 1 - float(np.abs(cdf[1:, :, :-1] - cdf[:1, :, :-1]).sum(2).mean()) / bins
        return out

    def score(t: np.ndarray) -> np.ndarray:
        return np.where((t[:, 2:] == 0).any(axis=1), 0.0, t @ w / w.sum())

    def greedy(rng: np.random.Generator) -> np.ndarray:
        fill, out = np.zeros(3), np.zeros(n_groups, dtype=np.int64)
        size = h.sum((1, 2))
        for g in sorted(rng.permutation(n_groups).tolist(), key=lambda g: -size[g]):
            out[g] = int(np.argmin(fill / want))
            fill[out[g]] += size[g]
        return out

    def mutate(c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return np.where(rng.random(len(c)) < 0.05, rng.integers(0, 3, len(c)), c)

    def crossover(a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return np.where(rng.random(len(a)) < 0.5, a, b)

    rng = np.random.default_rng(seed)
    start = np.stack([greedy(rng), *[mutate(greedy(rng), rng) for _ in range(population - 1)]])
    best, fit = evolve(start, lambda pop: score(terms(pop)), mutate, crossover, generations, seed)
    far_test, far_valid, ratio, response = terms(best[None])[0].tolist()
    out = [(g, SUBSETS[int(c)], fit, far_test, far_valid, ratio, response) for g, c in enumerate(best)]
    return histogram.sparkSession.createDataFrame(out, "group int, subset string, fitness double, far_test double, far_valid double, ratio double, response double")


def ave_minimize(near: DataFrame, key: str, label: str, test: float = 0.2, generations: int = 20, population: int = 30, blocks: int = 64, seed: int = 0) -> DataFrame:
    """SPL7: ``block, is_test, bias``: the split of least asymmetric bias that a genetic search over blocks of rows finds.

    ``near``: per row ``key``, ``label`` (1 active, 0 inactive) and, for every block of rows, the distance to the block's nearest active and inactive
    (``to_active, to_inactive``: arrays of ``blocks`` distances, infinite where there is none).  Actives and inactives of a block go to one side together, a share ``test`` of the
    blocks to the test side.  The bias of a population is graded in one distributed pass: each test row takes its least distances over the blocks in train.
    """
    schema = "chromosome int, active int, n bigint, gain double"
    rows = near.select(F.col(label).cast("int").alias("active"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), "to_active", "to_inactive")

    def grade(pop: np.ndarray) -> np.ndarray:
        shared = near.sparkSession.sparkContext.broadcast(pop)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pop = shared.value
            total = np.zeros((len(pop), 2, 2))
            steps = lambda d: np.clip(101 - np.ceil(np.maximum(np.minimum(d, 2.0), 0) * 100 - 1e-9), 0, None) / 101
            for b in batches:
                act, block = b.column("active").to_numpy(zero_copy_only=False), b.column("block").to_numpy(zero_copy_only=False)
                a, i = (np.array(b.column(c).to_pylist(), dtype=float).reshape(len(act), blocks) for c in ("to_active", "to_inactive"))
                for c, row in enumerate(pop):
                    train = row == 0
                    near_a, near_i = a[:, train].min(axis=1), i[:, train].min(axis=1)
                    same, other = np.where(act == 1, near_a, near_i), np.where(act == 1, near_i, near_a)
                    gain = steps(same) - steps(other)
                    for y in (0, 1):
                        mine = (row[block] == 1) & (act == y)
                        total[c, y] += (mine.sum(), gain[mine].sum())
            c, y = np.indices(total.shape[:2])
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel().astype(np.int32)), pa.array(y.ravel().astype(np.int32)), pa.array(total[:, :, 0].ravel().astype(np.int64)), pa.array(total[:, :, 1].ravel())], ["chromosome", "active", "n", "gain"])

        out, seen = np.zeros(len(pop)), np.zeros(len(pop), dtype=int)
        for r in rows.mapInArrow(run, schema).groupBy("chromosome", "active").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain")).collect():
            if r.n:
                out[r.chromosome] += r.gain / r.n
                seen[r.chromosome] += 1
        # A side without actives or inactives is no split.
        return np.where(seen == 2, -np.abs(out), -np.inf)

    take = max(1, min(blocks - 1, round(blocks * test)))

    def exact(c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Back to the wanted number of test blocks."""
        for v, more in ((1, take - int(c.sum())), (0, int(c.sum()) - take)):
            if more > 0:
                c = c.copy()
                c[rng.choice(np.flatnonzero(c != v), more, replace=False)] = v
        return c

    def mutate(c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return exact(np.where(rng.random(blocks) < 0.05, 1 - c, c), rng)

    rng = np.random.default_rng(seed)
    start = np.stack([exact(np.zeros(blocks, dtype=np.int64), rng) for _ in range(population)])
    best, fit = evolve(start, grade, mutate, lambda a, b, r: np.where(r.random(blocks) < 0.5, a, b), generations, seed)
    return near.sparkSession.createDataFrame([(i, bool(v), -fit) for i, v in enumerate(best)], "block int, is_test boolean, bias double")
