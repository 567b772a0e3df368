"""Problem 1: references to records that do not exist when the reference is made.

A parent row is alive in a run of consecutive microseconds, from its start to the one before its end.  Parent instants (key,
microsecond) are integers in sorted order; overlapping and adjacent rows of one key are merged into contiguous runs.  Each reference
is matched as-of to the run that starts at or before it and reported if it lies beyond that run's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicata.plans.range_scan import last_row, range_sorted, starts
from replicata.plans.storage import materialize, release

_NEVER, _FOREVER = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_ORIGIN = "timestamp_ntz'1970-01-01 00:00:00'"

_RUNS_SCHEMA = "key string, start_us bigint, end_us bigint"
_SCAN_SCHEMA = "ref_table string, row_id bigint, at_us bigint, seen boolean, head boolean, pid int, head_key string, tail_key string, tail_end bigint"


def _micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_ORIGIN}, cast(`{c}` as timestamp_ntz))")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and adjacent rows of a key in a sorted partition become one run."""
    open_key, run = None, None  # the run that the next batch may continue
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key")
        start, end = (b.column(c).to_numpy(zero_copy_only=False) for c in ("start_us", "end_us"))
        if run is not None:
            key = pa.concat_arrays([pa.array([open_key], pa.string()), key])
            start, end = np.concatenate([[run[0]], start]), np.concatenate([[run[1]], end])
        opens = starts([key], None)
        ends = pd.Series(end).groupby(np.cumsum(opens)).cummax().to_numpy()
        opens[1:] |= start[1:] > ends[:-1]
        at = np.flatnonzero(opens)
        done = ends[np.append(at[1:], len(start)) - 1]
        if len(at) > 1:
            yield pa.RecordBatch.from_arrays([key.take(pa.array(at[:-1])), pa.array(start[at[:-1]]), pa.array(done[:-1])], ["key", "start_us", "end_us"])
        open_key, run = key[-1].as_py(), (int(start[at[-1]]), int(done[-1]))
    if run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_key], pa.string()), pa.array([run[0]], pa.int64()), pa.array([run[1]], pa.int64())], ["key", "start_us", "end_us"])


def parent_runs(parents: DataFrame) -> DataFrame:
    """``key, start_us, end_us``: the contiguous runs of microseconds, end excluded, in which each key has a living parent row.

    ``parents``: ``key, start, end``, alive in ``start <= t < end`` (null end: never ends; null start or an end not after it: never alive).
    Rows of one key and start shrink before the one range-partitioned sort; a key of any size spreads over partitions, and where two
    partitions meet inside a key its run may be cut or a later run overlap it: at most that many rows more than the fewest.
    """
    alive = parents.filter("key is not null and start is not null and (end is null or end > start)").select("key", _micros("start").alias("start_us"), F.coalesce(_micros("end"), F.lit(_FOREVER)).alias("end_us"))
    return range_sorted(alive.groupBy("key", "start_us").agg(F.max("end_us").alias("end_us")), "key", "start_us").mapInArrow(_merge, _RUNS_SCHEMA)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References beyond every run of this partition, and one summary row (``head`` null) of the partition."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _SCAN_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int64()]
    head_key, before, run_end, seen, in_head = None, None, _NEVER, False, True
    for b in batches:
        if not b.num_rows:
            continue
        key, is_ref = b.column("key"), b.column("is_ref").to_numpy(zero_copy_only=False)
        if before is None:
            head_key = key[0].as_py()
        new = starts([key], before)
        seg = np.cumsum(new)
        at = b.column("at_us").to_numpy(zero_copy_only=False)
        end = np.where(is_ref, _NEVER, b.column("end_us").to_numpy(zero_copy_only=False))
        if not new[0]:
            end[0] = max(end[0], run_end)
        ends = pd.Series(end).groupby(seg).cummax().to_numpy()
        parents = np.where(is_ref, 0, 1)
        if not new[0] and seen:
            parents[0] = 1
        had = pd.Series(parents).groupby(seg).cummax().to_numpy().astype(bool)
        first_new = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(new)
        heads = np.zeros(len(new), dtype=bool)
        if in_head and (before is None or not new[0]):
            heads[:first_new] = True
            in_head = first_new == len(new)
        else:
            in_head = False
        before, run_end, seen = last_row([key]), int(ends[-1]), bool(had[-1])
        lost = np.flatnonzero(is_ref & (ends <= at))
        if len(lost):
            take = pa.array(lost)
            nulls = lambda t: pa.nulls(len(lost), t)
            yield pa.RecordBatch.from_arrays(
                [b.column("ref_table").take(take), b.column("row_id").take(take), pa.array(at[lost]), pa.array(had[lost]), pa.array(heads[lost]), pa.array(np.full(len(lost), pid, np.int32)), nulls(pa.string()), nulls(pa.string()), nulls(pa.int64())], names
            )
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([None, None, None, seen, None, pid, head_key, before[0], run_end], types, strict=True)], names)


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References for which no parent row with an equal key was alive at their time.

    ``refs``: ``ref_table, row_id, key, at``; ``parents``: ``key, start, end``, alive in ``start <= at < end`` (null end:
    never ends; null start: never).  A null key is no reference; a reference with a null time has no living parent.
    Returns ``ref_table, row_id, at, reason``: ``ended`` if some parent row started at or before that time, else ``not_yet``
    (missing altogether or arriving later).  Extra columns of either side are ignored; repeated rows come out repeatedly.

    Parents become runs first (:func:`parent_runs`); references and runs go through one range-partitioned sort on (key, time), so that a key of
    any size spreads over partitions.  What earlier partitions know of a partition's first key is one number each, gathered on the
    driver (as many rows as partitions).
    """
    spark = refs.sparkSession
    ref_rows = refs.filter("key is not null").select("key", F.coalesce(_micros("at"), F.lit(_NEVER)).alias("at_us"), F.lit(True).alias("is_ref"), F.lit(0).cast("bigint").alias("end_us"), "ref_table", F.col("row_id").cast("bigint").alias("row_id"))
    runs = materialize(parent_runs(parents))
    run_rows = runs.select("key", F.col("start_us").alias("at_us"), F.lit(False).alias("is_ref"), "end_us", F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("bigint").alias("row_id"))
    found = materialize(range_sorted(ref_rows.unionByName(run_rows), "key", "at_us", "is_ref", "row_id").mapInArrow(_scan, _SCAN_SCHEMA))
    release(runs)
    carries, tail_key, tail_end, tail_seen = [], None, _NEVER, False
    for r in sorted(found.filter("head is null").select("pid", "head_key", "tail_key", "tail_end", "seen").collect(), key=lambda r: r.pid):
        if tail_key == r.head_key:
            carries.append((r.pid, tail_end, tail_seen))
        same = tail_key == r.tail_key
        tail_key, tail_end, tail_seen = r.tail_key, max(r.tail_end, tail_end if same else _NEVER), r.seen or (same and tail_seen)
    before = spark.createDataFrame(carries, "pid int, carry_end bigint, carry_seen boolean")
    out = found.filter("head is not null").join(F.broadcast(before), (found["pid"] == before["pid"]) & found["head"], "left")
    lost = F.col("carry_end").isNull() | (F.col("carry_end") <= F.col("at_us"))
    at = F.when(F.col("at_us") != F.lit(_NEVER), F.expr(f"timestampadd(MICROSECOND, at_us, {_ORIGIN})"))
    return out.filter(lost).select("ref_table", "row_id", at.alias("at"), F.when(F.col("seen") | F.coalesce("carry_seen", F.lit(False)), "ended").otherwise("not_yet").alias("reason"))
