"""Distances, neighbours, applicability domain, clusters (DST, JN13).

A stated set of queries is compared with all rows, in blocks: each block of queries is a matrix of bounded size that every task gets,
and a task keeps the k best of its rows per query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_VALUES = 4_000_000  # numbers in a block of queries (32 MB)
PAIR_VALUES = 4_000_000  # distances that a task holds at once (32 MB)
AXES = 64  # directions in which sets are compared before their elements are counted
TILE = 512  # queries and rows that are compared at once (1 MB)
MAY = 100_000  # pairs whose elements are counted at once


def _matrix(column: pa.ListArray | pa.FixedSizeListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances between the rows of two matrices: euclidean, cosine, jaccard (of 0/1 rows)."""
    if metric == "euclidean":
        # differences, not the expanded square: equal rows are at exactly 0
        out = np.empty((len(q), len(x)))
        for i, row in enumerate(q):
            d = x - row
            out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out
    if metric == "cosine":
        nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (q @ x.T) / np.outer(nq, nx)
    if metric == "jaccard":
        both = (q > 0).astype(float) @ (x > 0).astype(float).T
        either = (q > 0).sum(1)[:, None] + (x > 0).sum(1)[None, :] - both
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(either > 0, 1 - both / either, 0.0)
    raise ValueError(f"unknown metric {metric}")


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """The queries in blocks of bounded size, one block at a time on the driver."""
    ids, rows = [], []
    for r in queries.filter("v is not null").select("id", "v").toLocalIterator():
        ids.append(r.id)
        rows.append(np.asarray(r.v, dtype=np.float64))
        if len(rows) * len(rows[0]) >= BLOCK_VALUES:
            yield ids, np.vstack(rows)
            ids, rows = [], []
    if rows:
        yield ids, np.vstack(rows)


def _slices(b: pa.RecordBatch, queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A batch as matrices with their ids, so few rows each that their distances to all queries of a block stay bounded."""
    step = max(1, PAIR_VALUES // max(1, queries))
    for i in range(0, b.num_rows, step):
        s = b.slice(i, step)
        yield _matrix(s.column("v")), s.column("id").to_numpy(zero_copy_only=False)


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str, skip_self: bool = False) -> DataFrame:
    """DST7: ``query_id, id, distance, rank`` (1 .. k) of the k nearest rows of each query, equal distances by the smaller id.

    Both sides have ``id`` (number) and ``v`` (array of equal lengths); null vectors and undefined distances match nothing; with ``skip_self``
    a row is no neighbour of itself.  Fewer than k rows give fewer neighbours.
    """
    spark = rows.sparkSession
    schema = "query_id bigint, id bigint, distance double"
    parts = spark.createDataFrame([], schema)
    for ids, block in _blocks(queries):
        shared = spark.sparkContext.broadcast((np.asarray(ids, dtype=np.int64), block))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            best_d = np.full((len(qid), k), np.inf)
            best_i = np.full((len(qid), k), np.iinfo(np.int64).max)
            for x, xid in (s for b in batches for s in _slices(b, len(qid))):
                d = distances(q, x, metric)
                d[np.isnan(d)] = np.inf
                if skip_self:
                    d[qid[:, None] == xid[None, :]] = np.inf
                alld, alli = np.hstack([best_d, d]), np.hstack([best_i, np.broadcast_to(xid, d.shape)])
                order = np.lexsort((alli, alld), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(alld, order, 1), np.take_along_axis(alli, order, 1)
            ok = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, k)[ok.ravel()]), pa.array(best_i[ok]), pa.array(best_d[ok])], ["query_id", "id", "distance"])

        parts = parts.unionByName(rows.filter("v is not null").select(F.col("id").cast("bigint").alias("id"), "v").mapInArrow(scan, schema))
    # At most k rows per query and task are left.
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pair_distances(queries: DataFrame, rows: DataFrame, metric: str, cutoff: float | None = None) -> DataFrame:
    """DST1, DST2: ``query_id, id, distance`` of each query with all rows, up to a cutoff if one is given."""
    spark = rows.sparkSession
    schema = "query_id bigint, id bigint, distance double"
    parts = spark.createDataFrame([], schema)
    for ids, block in _blocks(queries):
        shared = spark.sparkContext.broadcast((np.asarray(ids, dtype=np.int64), block))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            for x, xid in (s for b in batches for s in _slices(b, len(qid))):
                d = distances(q, x, metric)
                i, j = np.nonzero(~np.isnan(d) if cutoff is None else d <= cutoff)
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(xid[j]), pa.array(d[i, j])], ["query_id", "id", "distance"])

        parts = parts.unionByName(rows.filter("v is not null").select(F.col("id").cast("bigint").alias("id"), "v").mapInArrow(scan, schema))
    return parts


def summarize_distances(queries: DataFrame, rows: DataFrame, kind: str, metric: str, n: int = 1, within: bool = True) -> DataFrame:
    """DST3: per query ``nearest`` (distance of the nearest), ``nth_nearest``, ``avg_n_nearest``, ``farthest`` or ``avg``.

    ``within``: queries are among the rows; the first three leave a row's distance to itself out, the last two keep it.
    """
    if kind in ("nearest", "nth_nearest", "avg_n_nearest"):
        k = nearest(queries, rows, 1 if kind == "nearest" else n, metric, skip_self=within)
        if kind == "avg_n_nearest":
            return k.groupBy("query_id").agg(F.avg("distance").alias("distance"))
        return k.filter(F.col("rank") == (1 if kind == "nearest" else n)).select("query_id", "distance")
    if kind not in ("farthest", "avg"):
        raise ValueError(f"unknown summary {kind}")
    agg = F.max("most") if kind == "farthest" else F.sum("total") / F.sum("n")
    return _per_query(queries, rows, metric).groupBy("query_id").agg(agg.alias("distance"))


def _per_query(queries: DataFrame, rows: DataFrame, metric: str, cutoff: float | None = None) -> DataFrame:
    """``query_id, n, total, most``: count, sum and largest of each query's distances (up to a cutoff) to the rows of one task; no pair leaves it."""
    spark, schema = rows.sparkSession, "query_id bigint, n bigint, total double, most double"
    parts = spark.createDataFrame([], schema)
    for ids, block in _blocks(queries):
        shared = spark.sparkContext.broadcast((np.asarray(ids, dtype=np.int64), block))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            n, total, most = np.zeros(len(qid), np.int64), np.zeros(len(qid)), np.full(len(qid), -np.inf)
            for x, _ in (s for b in batches for s in _slices(b, len(qid))):
                d = distances(q, x, metric)
                ok = ~np.isnan(d) if cutoff is None else d <= cutoff
                n += ok.sum(1)
                total += np.where(ok, d, 0.0).sum(1)
                most = np.maximum(most, np.where(ok, d, -np.inf).max(1, initial=-np.inf))
            ok = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(qid[ok]), pa.array(n[ok]), pa.array(total[ok]), pa.array(most[ok])], ["query_id", "n", "total", "most"])

        parts = parts.unionByName(rows.filter("v is not null").select(F.col("id").cast("bigint").alias("id"), "v").mapInArrow(scan, schema))
    return parts


def tanimoto_pairs(queries: DataFrame, rows: DataFrame, bits: int = 1024, cutoff: float | None = None, both: str | None = None) -> DataFrame:
    """DST1: ``query_id, id, distance``: Tanimoto distance between arrays of set bits (``id``, ``bits``), up to a cutoff if one is given; two empty ones are at 0.

    Sets travel as they are and become rows of 0 and 1 only inside a task, a bounded number at a time.  With a cutoff below 1 only pairs that can be so near are counted out,
    and two sets that ``rows`` marks in its true or false column ``both`` as queries too (with the same unique ``id``) are compared once for both directions.
    """
    if cutoff is not None and cutoff < 1:
        return _near_sets(queries, rows, bits, cutoff, both)
    spark, schema = rows.sparkSession, "query_id bigint, id bigint, distance double"
    parts = spark.createDataFrame([], schema)

    def dense(sets: list, width: int) -> np.ndarray:
        out = np.zeros((len(sets), width), dtype=np.float32)
        at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        out[at, np.fromiter((i for x in sets for i in x), dtype=np.int64, count=len(at))] = 1
        return out

    def scan_with(shared):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, sets = shared.value
            q = dense(sets, bits)
            step = max(1, PAIR_VALUES // max(1, len(qid), bits))
            for b in batches:
                xid, xs = b.column("id").to_numpy(zero_copy_only=False), b.column("bits").to_pylist()
                for i in range(0, len(xs), step):
                    d = distances(q, dense(xs[i : i + step], bits), "jaccard")
                    r, c = np.nonzero(np.ones_like(d) if cutoff is None else d <= cutoff)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(xid[i : i + step][c]), pa.array(d[r, c].astype(np.float64))], ["query_id", "id", "distance"])

        return scan

    def send(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in block], dtype=np.int64), [x for _, x in block]))
        return rows.filter("bits is not null").select(F.col("id").cast("bigint").alias("id"), "bits").mapInArrow(scan_with(shared), schema)

    block = []
    for r in queries.filter("bits is not null").select("id", "bits").toLocalIterator():
        block.append((r.id, list(r.bits)))
        if len(block) * bits >= BLOCK_VALUES:
            parts, block = parts.unionByName(send(block)), []
    return parts.unionByName(send(block)) if block else parts


def _dense(column: pa.ListArray, width: int) -> np.ndarray:
    """Sets as rows of 0 and 1."""
    out = np.zeros((len(column), width), dtype=np.uint8)
    at = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
    out[at, column.flatten().to_numpy(zero_copy_only=False)] = 1
    return out


def _words(sets: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as 64-bit words."""
    b = np.packbits(sets, axis=1)
    return np.pad(b, ((0, 0), (0, -b.shape[1] % 8))).view(np.uint64)


def _axes(sets: np.ndarray) -> np.ndarray:
    """Orthonormal directions (columns) along which rows of 0 and 1 differ most, at most ``AXES``."""
    gram, n = np.zeros((sets.shape[1],) * 2), len(sets)
    for i in range(0, n, TILE):
        part = sets[i : i + TILE].astype(np.float32)
        gram += part.T @ part
    mean = sets.mean(axis=0)
    return np.linalg.eigh(gram / n - np.outer(mean, mean))[1][:, -AXES:].astype(np.float32)


def _packed(batches: Iterator[pa.RecordBatch], bits: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, words and marks of at most ``step`` sets at a time."""
    for b in batches:
        for part in (b.slice(lo, step) for lo in range(0, b.num_rows, step)):
            yield part.column("id").to_numpy(zero_copy_only=False), _words(_dense(part.column("bits"), bits)), part.column("both").to_numpy(zero_copy_only=False)


def _tiles(batches: Iterator[pa.RecordBatch], bits: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, words, sizes and marks of at most ``step`` sets at a time; about 64 times as many are put in the order of mark, size and id."""

    def ordered(held: list) -> Iterator[tuple]:
        ids, words, too = (np.concatenate(c) for c in zip(*held, strict=True))
        size = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        order = np.lexsort((ids, size, too))
        for at in (order[lo : lo + step] for lo in range(0, len(order), step)):
            yield ids[at], words[at], size[at], too[at]

    held, n = [], 0
    for x in _packed(batches, bits, step):
        held.append(x)
        n += len(x[0])
        if n >= 64 * step:
            yield from ordered(held)
            held, n = [], 0
    if held:
        yield from ordered(held)


def _near_sets(queries: DataFrame, rows: DataFrame, bits: int, cutoff: float, both: str | None = None) -> DataFrame:
    """:func:`tanimoto_pairs` up to a cutoff below 1, exactly, without counting the common elements of every pair.

    Sets of a and b elements within the cutoff c differ in at most c / (2 - c) * (a + b) elements.  That is the square of their euclidean distance as rows of
    0 and 1, and no projection on orthonormal directions is longer; so a pair whose projections lie farther apart is none.  One product of two narrow
    matrices gives that excess for all pairs of a tile (the last two columns hold the squares and sizes), and only pairs without one are counted out.
    Any orthonormal directions give the same pairs: those of the first block of queries serve all blocks.

    Queries and rows are compared in the order of their sizes, and tiles are left out whose sizes alone are too different.  Of two sets that are both queries and rows the smaller one
    (at equal size that of the smaller id) is the query, so if all rows are queries more than half of the tiles are left out.
    """
    spark, schema = rows.sparkSession, "query_id bigint, id bigint, distance double"
    parts = spark.createDataFrame([], schema)
    share = cutoff / (2 - cutoff) + 1e-5  # with room for rounding in single precision, as is the 0.25 below: numbers of elements are whole
    block = max(1, 16 * BLOCK_VALUES // bits)

    def projected(sets: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Projections and the room that a set leaves to its pairs: its share of the elements that may differ less its square."""
        x = sets.astype(np.float32) @ axes
        return x, (share * sets.sum(axis=1, dtype=np.int64) - np.einsum("ij,ij->i", x, x, dtype=np.float64) + 0.125).astype(np.float32)

    def scan_with(shared):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q_words, q_size, axes, q = shared.value

            def near(may: list, xid: np.ndarray, words: np.ndarray, size: np.ndarray, too: np.ndarray) -> pa.RecordBatch:
                """Of pairs of queries and rows, by their places, those within the cutoff; of two queries also the other way round."""
                i, j = (np.concatenate(c) for c in zip(*may, strict=True))
                common = np.bitwise_count(q_words[i] & words[j]).sum(axis=1, dtype=np.int64)
                either = q_size[i] + size[j] - common
                d = np.where(either > 0, 1 - common / np.maximum(either, 1), 0.0)
                ok = (d <= cutoff) & (~too[j] | (q_size[i] < size[j]) | ((q_size[i] == size[j]) & (qid[i] <= xid[j])))
                a, b, d, back = qid[i[ok]], xid[j[ok]], d[ok], too[j[ok]]
                back &= a != b
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((a, b[back]), (b, a[back]), (d, d[back]))], ["query_id", "id", "distance"])

            for xid, words, size, too in _tiles(batches, bits, TILE):
                p, room = projected(np.unpackbits(words.view(np.uint8), axis=1, count=bits), axes)
                x = np.hstack([p, np.ones((len(p), 1), np.float32), room[:, None]]).T
                # The smaller of two sets within the cutoff has at least the share 1 - cutoff of the larger one's elements.
                first = np.searchsorted(q_size, (1 - cutoff) * size.min() - 1e-6)
                upto = np.searchsorted(q_size, size.max() if too.all() else size.max() / (1 - cutoff) + 1e-6, side="right")
                may, n = [], 0
                for top in range(first, upto, TILE):
                    at = np.flatnonzero(q[top : min(top + TILE, upto)] @ x >= 0)
                    for k in range(0, len(at), MAY):
                        i, j = np.divmod(at[k : k + MAY], len(xid))
                        may.append((i + top, j))
                        n += len(i)
                        if n >= MAY:
                            yield near(may, xid, words, size, too)
                            may, n = [], 0
                if may:
                    yield near(may, xid, words, size, too)

        return scan

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, _ in _packed(batches, bits, min(TILE, block)):
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([words.tobytes()], pa.binary())], ["ids", "words"])

    def given(df: DataFrame, mark: Column) -> DataFrame:
        return df.filter("bits is not null").select(F.col("id").cast("bigint").alias("id"), "bits", mark.alias("both"))

    def send(held: list, axes: np.ndarray | None) -> tuple[DataFrame, np.ndarray]:
        ids, words = (np.concatenate(c) for c in zip(*held, strict=True))
        size = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        order = np.lexsort((ids, size))
        ids, words, size = ids[order], words[order], size[order]
        sets = np.unpackbits(words.view(np.uint8), axis=1, count=bits)
        axes = _axes(sets) if axes is None else axes
        p, room = (np.concatenate(c) for c in zip(*[projected(sets[i : i + TILE], axes) for i in range(0, len(sets), TILE)], strict=True))
        q = np.hstack([2 * p, room[:, None], np.ones((len(p), 1), np.float32)])
        shared = spark.sparkContext.broadcast((ids, words, size, axes, q))
        too = F.coalesce(F.col(both), F.lit(False)) if both else F.lit(False)
        return given(rows, too).mapInArrow(scan_with(shared), schema), axes

    held, n, axes = [], 0, None
    for r in given(queries, F.lit(True)).mapInArrow(packed, "ids binary, words binary").toLocalIterator():
        ids = np.frombuffer(r.ids, np.int64)
        held.append((ids, np.frombuffer(r.words, np.uint64).reshape(len(ids), -1)))
        n += len(ids)
        if n >= block:
            near, axes = send(held, axes)
            parts, held, n = parts.unionByName(near), [], 0
    return parts.unionByName(send(held, axes)[0]) if held else parts


def neighbour_counts(queries: DataFrame, rows: DataFrame, metric: str, cutoff: float) -> DataFrame:
    """DST6: rows within the cutoff of each query, itself included."""
    return _per_query(queries, rows, metric, cutoff).groupBy("query_id").agg(F.sum("n").alias("n"))


def butina(rows: DataFrame, metric: str, cutoff: float) -> DataFrame:
    """DST6: ``id, cluster`` (0, 1, ... in the order of picking): rows are picked by falling neighbour count (ties: the smaller id) and take their free neighbours.

    Decided in rounds in Spark: a free row with no free neighbour before it is a centre, its neighbours are none; in the end every row joins
    its first centre.  That is what picking one by one gives.  Null vectors are in no cluster; repeated ids count once.
    """
    from replicata.operators.joins import with_ordinal
    from replicata.plans.storage import materialize, release

    e = pair_distances(rows, rows, metric, cutoff).select(F.col("query_id").alias("a"), F.col("id").alias("b")).distinct()
    n = materialize(e.groupBy("a").agg(F.count("*").alias("n")))
    rank = with_ordinal(n.select((-F.col("n")).alias("o"), "a"), "o", "a").select(F.col("a").alias("b"), F.col("ordinal").alias("rank"))
    e = materialize(e.join(rank, "b").join(rank.select(F.col("b").alias("a"), F.col("rank").alias("own")), "a"))
    free, centres = materialize(e.select("a").distinct()), None
    while not free.isEmpty():
        live = e.join(free, "a").join(free.withColumnRenamed("a", "b"), "b")
        new = materialize(live.groupBy("a").agg(F.min("rank").alias("first"), F.min("own").alias("own")).filter("first = own").select("a", "own"))
        rest = materialize(free.join(e.join(new.select(F.col("a").alias("b")), "b").select("a"), "a", "left_anti"))
        centres = new if centres is None else centres.unionByName(new)
        release(free)
        free = rest
    if centres is None:
        return n.select(F.col("a").alias("id"), F.lit(0).cast("bigint").alias("cluster"))
    order = with_ordinal(centres, "own").select(F.col("own").alias("rank"), F.col("ordinal").alias("cluster"))
    return e.join(order, "rank").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))


def ad_zscore(queries: DataFrame, train: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """DST8: ``query_id, ad_index``: mean distance to the k nearest training rows, standardized by those of the training rows, at least 1e-6.

    Training means run over k + 1 nearest with the row itself, divided by k.  A deviation of 0 counts as 1e-6.
    """
    own = nearest(train, train, k + 1, metric).groupBy("query_id").agg((F.sum("distance") / k).alias("d"))
    s = own.agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s"))
    q = nearest(queries, train, k, metric).groupBy("query_id").agg(F.avg("distance").alias("d"))
    z = F.greatest((F.col("d") - F.col("m")) / F.when(F.col("s") == 0, 1e-6).otherwise(F.col("s")), F.lit(1e-6))
    return q.crossJoin(F.broadcast(s)).select("query_id", z.alias("ad_index"))


def ad_local_density(queries: DataFrame, train: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """DST9: a query's mean distance to its k nearest training rows over the mean of those rows' own; 0 counts as 1e-6."""
    own = nearest(train, train, k + 1, metric).groupBy("query_id").agg((F.sum("distance") / k).alias("own")).withColumnRenamed("query_id", "id")
    near = nearest(queries, train, k, metric).join(own, "id").groupBy("query_id").agg(F.avg("distance").alias("d"), F.avg("own").alias("o"))
    safe = lambda c: F.when(F.col(c) == 0, 1e-6).otherwise(F.col(c))
    return near.select("query_id", (safe("d") / safe("o")).alias("ad_index"))


def applicability(queries: DataFrame, train: DataFrame, k: int, method: str = "z_score", metric: str = "euclidean", most_train: int | None = None, seed: int = 0) -> DataFrame:
    """DST10: ``query_id, ad_index, neighbours`` after features are prepared: those that are missing in all training rows are dropped, other missing ones
    get the training mean.  ``neighbours``: ids of the k nearest training rows.

    ``most_train``: on request only this many training rows, by the hash of their id, are used; by default all are.
    """
    from replicata.operators.curate import cap_rows

    if method not in ("z_score", "local_density"):
        raise ValueError(f"unknown method {method}")
    if most_train is not None:
        train = cap_rows(train, "id", most_train, seed)
    per = train.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.when(~F.isnan("x"), F.col("x"))).alias("mean"))
    means = [r.mean for r in per.orderBy("i").collect()]  # one number per feature
    places = [i for i, m in enumerate(means) if m is not None]
    clean = lambda d: d.filter("v is not null").select("id", F.array(*[F.coalesce(F.when(~F.isnan(F.get("v", F.lit(i))), F.get("v", F.lit(i)).cast("double")), F.lit(float(means[i]))) for i in places]).alias("v"))
    q, t = clean(queries), clean(train)
    index = (ad_zscore if method == "z_score" else ad_local_density)(q, t, k, metric)
    ids = nearest(q, t, k, metric).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("neighbours"))
    return index.join(ids, "query_id")


def diversity(rows: DataFrame, metric: str, k: int, share: int = 20) -> DataFrame:
    """DST11: ``id, nearest, mean_k, mean_all`` for the rows whose id is divisible by ``share``: distances to all rows, the numbers behind a diversity report."""
    q = rows.filter(F.col("id") % share == 0)
    near = nearest(q, rows, k, metric, skip_self=True).groupBy("query_id").agg(F.min("distance").alias("nearest"), F.avg("distance").alias("mean_k"))
    return near.join(summarize_distances(q, rows, "avg", metric).withColumnRenamed("distance", "mean_all"), "query_id").withColumnRenamed("query_id", "id")
