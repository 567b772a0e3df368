"""Problem 4: same or near-same records across the splits.

Structures play the part of texts.  Every different text is numbered once, whatever splits it stands in, and near pairs are sought
between these numbers alone.  A text within d edits of another shares at least one of the d + 1 disjoint n-grams that the shorter one is
cut into, shifted by at most d places.  The hashes of n-grams are partitioned and joined, hits shrink to one row per pair and are verified by the
exact edit distance; the containment of each evaluation record in each training record is the share of its short n-grams found there.
Last of all the pairs of texts are expanded to rows of one split.  No pair within d edits can be missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicata.plans.skew import join_pairs
from replicata.plans.storage import materialize, release

GRAM = 3


def _cut(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of n-gram ``i`` of a text of ``length`` cut into ``parts``: the last ones are longer."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    short = F.lit(parts) - longer
    start = base * i + F.greatest(F.lit(i) - short, F.lit(0)) + 1
    return start, base + F.when(F.lit(i) >= short, 1).otherwise(0)


def _probe_shifts(d: int) -> list[tuple[int, int, int]]:
    """``(length difference, n-gram, shift)`` at which a text can share n-gram i of another, not longer one within ``d`` edits.

    With k edits left of the n-gram and d - k right of it, a shift s needs |s| <= k edits on the left and |difference - s| on the right; of the
    d + 1 n-grams the i-th can be taken as the first one without an edit, so k >= i.
    """
    return [(diff, i, s) for diff in range(-d, 1) for i in range(d + 1) for s in range(-d, d + 1) if max(abs(s), i) + abs(diff - s) <= d]


def ngram_hashes(texts: DataFrame, d: int) -> DataFrame:
    """``h, id, probe, n``: the d + 1 disjoint n-grams of each text (``probe`` null), and those of it that a text of ``n`` characters, not longer than
    it, may have within ``d`` edits (``probe``: whether that text is shorter), as 64-bit hashes over length, place and n-gram."""
    text, n = F.col("text"), F.length("text")
    keys = []
    for i in range(d + 1):
        start, size = _cut(n, i, d + 1)
        keys.append(F.struct(F.xxhash64(n, F.lit(i), F.substring(text, start, size)).alias("h"), F.lit(None).cast("boolean").alias("probe"), n.alias("n")))
    for diff, i, s in _probe_shifts(d):
        cut_start, size = _cut(n + diff, i, d + 1)
        start = cut_start - s
        ok = (n + diff >= 0) & (start >= 1) & (start + size - 1 <= n)
        keys.append(F.when(ok, F.struct(F.xxhash64(n + diff, F.lit(i), F.substring(text, start, size)).alias("h"), F.lit(diff < 0).alias("probe"), (n + diff).alias("n"))))
    return texts.select("id", F.explode(F.array_compact(F.array(*keys))).alias("g")).select("g.h", "id", "g.probe", "g.n")


def residues(text: Column, d: int) -> Column:
    """Hashes of all that is left of a text when up to ``d`` characters are deleted; texts within d edits share one."""
    level = F.array(text)
    every = level
    drop = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substr(t, i + 1)))
    for _ in range(d):
        level = F.array_distinct(F.flatten(F.transform(level, lambda t: F.when(F.length(t) > 0, drop(t)).otherwise(F.array().cast("array<string>")))))
        every = F.concat(every, level)
    return F.transform(F.array_distinct(every), lambda t: F.xxhash64(t))


def containment(a: Column, b: Column) -> Column:
    """Share of the different short n-grams of ``a`` that ``b`` has; a text shorter than an n-gram is its only one."""
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (GRAM - 1), F.lit(1))), lambda i: F.substr(t, i, F.lit(GRAM))))
    return F.size(F.array_intersect(grams(a), grams(b))) / F.size(grams(a))


def near_texts(texts: DataFrame, d: int = 2, heavy_pairs: int = 10_000_000, short: int = 200) -> DataFrame:
    """Pairs of texts at most ``d`` edits apart, each pair once: ``a, b, distance, a_in_b, b_in_a``, the last two being containments.

    ``texts``: ``id, text``, ids and texts unique and not null; it is read three times and should be a written table.  The empty text is a text.
    Only ids and hashes are shuffled before a pair is known, and every pair is verified once.

    An n-gram that would give more than ``heavy_pairs`` pairs is not paired out: its texts, unless longer than ``short`` characters, are paired by
    what is left of them without up to d characters, so that only texts at most 2 d edits apart meet.  Longer ones are paired out
    over as many tasks as their pairs need.  Neither loses a pair.
    """
    grams = materialize(ngram_hashes(texts, d))
    sizes = grams.groupBy("h").agg(F.count_if(F.col("probe").isNull()).alias("_c"), F.count("probe").alias("_p"), F.max("n").alias("_n"))
    heavy = materialize(sizes.filter(F.col("_c").cast("double") * F.col("_p") > heavy_pairs).select("h", (F.col("_n") <= short).alias("_short")))

    def hits(g: DataFrame, join) -> DataFrame:
        cut, probe = g.filter("probe is null").select("h", F.col("id").alias("b")), g.filter("probe is not null").select("h", F.col("id").alias("a"), "probe")
        return join(probe, cut).filter(F.col("probe") | (F.col("a") > F.col("b"))).select("a", "b")

    if heavy.isEmpty():
        found = hits(grams, lambda x, y: x.join(y, "h"))
    else:
        found = hits(grams.join(heavy, "h", "left_anti"), lambda x, y: x.join(y, "h"))
        found = found.unionByName(hits(grams.join(heavy.filter("not _short"), "h", "left_semi"), lambda x, y: join_pairs(x, y, ["h"], heavy_pairs)))
        dense = texts.join(grams.join(heavy.filter("_short"), "h", "left_semi").select("id").distinct(), "id")
        left = materialize(dense.select("id", F.explode(residues(F.col("text"), d)).alias("r")))
        found = found.unionByName(join_pairs(left.select("r", F.col("id").alias("a")), left.select("r", F.col("id").alias("b")), ["r"], heavy_pairs).filter("a > b").select("a", "b"))
    pairs = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    named = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"{x}_text"))
    near = pairs.join(named("a"), "a").join(named("b"), "b").withColumn("distance", F.levenshtein("a_text", "b_text", d)).filter("distance >= 0")
    a, b = F.col("a_text"), F.col("b_text")
    out = materialize(near.select("a", "b", "distance", containment(a, b).alias("a_in_b"), containment(b, a).alias("b_in_a")))
    release(grams)
    release(heavy)
    return out


def overlap_records(rows: DataFrame, texts: DataFrame, d: int = 2, heavy_pairs: int = 10_000_000) -> DataFrame:
    """``eval_row, train_row, same_key, distance, containment``: a valid or test row and a train row of one split and fold whose keys are equal or of
    which two texts are at most ``d`` edits apart.

    ``rows``: ``row_id, split_uuid, fold, subset, key``; ``texts``: ``key, text`` (a key can have several, a text several keys; rows with a null in
    either count for nothing).  Rows with a null key, split, fold or subset take part in nothing; ``row_id`` is unique.  Each pair comes out once.  ``containment`` is the share
    of the evaluation record's n-grams that the training record has; of several texts of a key the nearest pair counts, then the larger containment.
    Pairs of equal keys have distance 0 and containment 1.

    Rows are paired last, and keys or texts that stand in very many rows of a split are dealt to several tasks.
    """
    scope = ["split_uuid", "fold"]
    r = materialize(rows.dropna(subset=["key", "subset", *scope]).select("row_id", *scope, (F.col("subset") == "train").alias("is_train"), "key"))
    known = materialize(texts.dropna(subset=["key", "text"]).select("key", "text").distinct())
    used = known.join(r.select("key").distinct(), "key", "left_semi")
    numbered = materialize(used.select("text").distinct().withColumn("id", F.monotonically_increasing_id()))
    per_key = used.join(numbered, "text").groupBy("key").agg(F.collect_list("id").alias("ids"))
    # A key's texts are few: different structures of one compound.  Rows stay one per key until pairs are made.
    w = materialize(r.join(per_key, "key", "left").withColumn("several", F.coalesce(F.size("ids") > 1, F.lit(False))))
    near = near_texts(numbered, d, heavy_pairs)
    both = near.select(F.col("a").alias("id"), F.col("b").alias("other"), "distance", F.col("a_in_b").alias("containment")).unionByName(near.select(F.col("b").alias("id"), F.col("a").alias("other"), "distance", F.col("b_in_a").alias("containment")))
    train, evaluation = w.filter("is_train").drop("is_train"), w.filter("not is_train").drop("is_train")
    e_texts = evaluation.select(*scope, F.explode("ids").alias("id"), F.col("row_id").alias("eval_row"), F.col("key").alias("e_key"), F.col("several").alias("e_several"))
    t_texts = train.select(*scope, F.explode("ids").alias("other"), F.col("row_id").alias("train_row"), F.col("key").alias("t_key"), F.col("several").alias("t_several"))
    # What an evaluation row looks for: its own texts and those near them.
    looks = e_texts.withColumns({"other": F.col("id"), "distance": F.lit(0), "containment": F.lit(1.0)}).unionByName(e_texts.join(both, "id")).drop("id")
    met = join_pairs(materialize(looks), t_texts, [*scope, "other"], heavy_pairs).filter("e_key <> t_key")
    met = met.select("eval_row", "train_row", (F.col("e_several") | F.col("t_several")).alias("several"), "distance", "containment")
    best = met.filter("several").groupBy("eval_row", "train_row").agg(F.min(F.struct("distance", (-F.col("containment")).alias("c"))).alias("m"))
    close = met.filter("not several").select("eval_row", "train_row", "distance", "containment").unionByName(best.select("eval_row", "train_row", F.col("m.distance").alias("distance"), (-F.col("m.c")).alias("containment")))
    same = join_pairs(evaluation.select(*scope, "key", F.col("row_id").alias("eval_row")), train.select(*scope, "key", F.col("row_id").alias("train_row")), [*scope, "key"], heavy_pairs)
    same = same.select("eval_row", "train_row", F.lit(True).alias("same_key"), F.lit(0).alias("distance"), F.lit(1.0).alias("containment"))
    return same.unionByName(close.select("eval_row", "train_row", F.lit(False).alias("same_key"), "distance", "containment"))


def overlap_pairs(rows: DataFrame, texts: DataFrame, d: int = 2) -> DataFrame:
    """The pairs of :func:`overlap_records` as ``row_id_a < row_id_b``."""
    return overlap_records(rows, texts, d).select(F.least("eval_row", "train_row").alias("row_id_a"), F.greatest("eval_row", "train_row").alias("row_id_b"))
