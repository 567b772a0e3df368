"""Problem 3: the N best rows of every group, the same ones on every run.

A global range-partitioned sort on group, score and identifier spreads a group of any size over partitions.  Each
partition counts its groups; the counts are prefix-summed over the partitions into exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replicata.plans.range_scan import last_row, range_sorted, starts


def _first_n(groups: list[str], n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows at a position up to ``n`` in their group inside this sorted partition, with that position."""
        from pyspark import TaskContext

        pid, before, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = starts([b.column(c) for c in groups], before)
            at = np.arange(len(new))
            first = np.maximum.accumulate(np.where(new, at, -1))
            pos = np.where(first < 0, count + at + 1, at - first + 1)
            before, count = last_row([b.column(c) for c in groups]), int(pos[-1])
            keep = pa.array(np.flatnonzero(pos <= n))
            if len(keep):
                out = b.take(keep)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(pos[pos <= n].astype(np.int64)), pa.array(np.full(len(keep), pid, np.int32))], [*out.schema.names, "local_pos", "pid"])

    return scan


def top_n_per_group(df: DataFrame, groups: list[str], score: str, identifier: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest ``score`` in each group, equal scores by smaller ``identifier``; adds ``position``.

    Left out: rows with a null group column or a null, NaN or infinite score.  0.0 equals -0.0.  Repeated rows count each;
    a null identifier comes first among equal scores.  The columns returned are groups, identifier and ``position``.

    Only groups x n rows and n rows for each further partition that a group spans survive the first pass, so the prefix
    sums run over at most n rows a partition and group.
    """
    s = F.col(score).cast("double") + F.lit(0.0)
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    for g in groups:
        ok = ok & F.col(g).isNotNull()
    gs = [f"g{i}" for i in range(len(groups))]
    rows = df.filter(ok).select(*[F.col(g).alias(x) for g, x in zip(groups, gs, strict=True)], (-s).alias("down"), F.col(identifier).alias("id"))
    ordered = range_sorted(rows, *gs, "down", "id").drop("down")
    schema = T.StructType([*ordered.schema.fields, T.StructField("local_pos", T.LongType()), T.StructField("pid", T.IntegerType())])
    local = ordered.mapInArrow(_first_n(gs, n), schema)
    counts = local.groupBy(*gs, "pid").agg(F.collect_list(F.struct("id", "local_pos")).alias("rows"), F.max("local_pos").alias("n_rows"))
    before = F.coalesce(F.sum("n_rows").over(Window.partitionBy(*gs).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    exact = counts.withColumn("before", before).filter(F.col("before") < n).select(*gs, "before", F.explode("rows").alias("r"))
    exact = exact.withColumn("position", F.col("before") + F.col("r.local_pos")).filter(F.col("position") <= n)
    return exact.select(*[F.col(x).alias(g) for g, x in zip(groups, gs, strict=True)], F.col("r.id").alias(identifier), "position")


def first_per_key(df: DataFrame, key: str, identifier: str, columns: list[str]) -> DataFrame:
    """Of rows with the same ``key`` the one with the smallest ``identifier``; rows with a null key all stay.

    A partial aggregate: a key of any size shrinks to one row per input partition before the shuffle.
    """
    best = F.min(F.struct(F.col(identifier), *[F.col(c) for c in columns])).alias("best")
    one = df.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select("best.*")
    return one.unionByName(df.filter(F.col(key).isNull()).select(identifier, *columns))
