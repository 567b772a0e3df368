"""Global order without hot tasks: range-partitioned sort, then one pass over each sorted partition.

A group may hold a third of all rows; since the sort keys go beyond the group, its rows spread over many
range partitions.  What a partition must know of its predecessors is one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


def range_sorted(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` in the total order ``order`` over its partitions: the bounds come from a sample, adjacent partitions may be coalesced."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def starts(columns: Iterable[pa.Array], before: list | None) -> np.ndarray:
    """Marks the rows of a sorted batch at which any of ``columns`` differs from the row above; nulls equal nulls.

    ``before`` has the values of the row above the batch, None at the start of a partition.
    """
    columns = list(columns)
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    for c in columns:
        if n > 1:
            a, b = c.slice(1), c.slice(0, n - 1)
            differ = pc.fill_null(pc.not_equal(a, b), True)
            both_null = pc.and_(pc.is_null(a), pc.is_null(b))
            out[1:] |= pc.and_not(differ, both_null).to_numpy(zero_copy_only=False)
    out[0] = before is None or any(c[0].as_py() != v for c, v in zip(columns, before, strict=True))
    return out


def last_row(columns: Iterable[pa.Array]) -> list:
    return [c[-1].as_py() for c in columns]


def running_sums(df: DataFrame, groups: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds running sums (inclusive) of columns of numbers in each group's ``order``: ``sums`` maps new names to columns; missing numbers add nothing.

    The order must tell rows of a group apart.  Rows are range-sorted on group and order and summed in the same pass; only the first group of a
    partition can have begun before it, and what came before is one row per partition, so that a group of any size spreads over tasks and
    nothing is shuffled a second time.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    from replicata.plans.storage import materialize

    names, columns = list(sums), list(sums.values())
    whole = {f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    typed = df.withColumns({f"_s{i}": F.col(c).cast("bigint" if c in whole else "double") for i, c in enumerate(columns)})
    # A group is told by whether its columns are missing and by their values; NaN equals NaN.
    extra = [StructField("_p", LongType()), StructField("_head", LongType()), StructField("_mark", LongType())]
    schema = StructType([StructField(f.name, f.dataType, True) for f in typed.schema.fields] + extra)
    keys = [F.col(g) for g in groups]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        before, acc, head, last = None, [0] * len(columns), True, None

        def mark(b: pa.RecordBatch, values: list, which: int) -> pa.RecordBatch:
            """A row that holds a group's columns and sums: of a partition's first (1) and last (2) group."""
            row = [b.column(n).slice(b.num_rows - 1 if which == 2 else 0, 1) if n in groups else pa.array([values[int(n[2:])]], b.schema.field(n).type) if n[:2] == "_s" and n[2:].isdigit() else pa.nulls(1, b.schema.field(n).type) for n in b.schema.names]
            return pa.RecordBatch.from_arrays([*row, *[pa.array([v], pa.int64()) for v in (pid, int(head), which)]], [*b.schema.names, "_p", "_head", "_mark"])

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = [b.column(g) for g in groups]
            new = starts(cols, before) if groups else np.arange(n) == (0 if last is None else n)
            if last is None:
                yield mark(b, acc, 1)
                new[0] = False
            at = np.flatnonzero(new)
            out = {}
            for i in range(len(columns)):
                v = b.column(f"_s{i}").fill_null(0).to_numpy(zero_copy_only=False)
                total = np.cumsum(v)
                base = np.zeros(n, dtype=total.dtype)
                first = int(at[0]) if len(at) else n
                base[:first] = -acc[i]
                for_seg = np.repeat(total[at] - v[at], np.diff(np.append(at, n))) if len(at) else base[n:]
                base[first:] = for_seg
                out[f"_s{i}"] = total - base
            acc = [out[f"_s{i}"][-1].item() for i in range(len(columns))]
            heads = np.zeros(n, dtype=np.int64)
            if head:
                heads[: int(at[0]) if len(at) else n] = 1
                head = not len(at)
            before, last = last_row(cols), b
            data = [pa.array(out[c], b.schema.field(c).type) if c in out else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*data, pa.array(np.full(n, pid)), pa.array(heads), pa.nulls(n, pa.int64())], [*b.schema.names, "_p", "_head", "_mark"])
        if last is not None:
            yield mark(last, acc, 2)

    placed = materialize(range_sorted(typed, *keys, *order).mapInArrow(scan, schema))
    own = [f"_s{i}" for i in range(len(columns))]
    alike = lambda x, y: all(p == q or (p != p and q != q) for p, q in zip(x, y, strict=True))
    carries, tail, held = [], None, []
    marks = placed.filter("_mark is not null").select("_p", "_mark", "_head", F.struct(*groups) if groups else F.struct(F.lit(0)), F.struct(*own)).collect()
    for pid, which, whole_one, group, values in sorted(marks, key=lambda r: (r[0], r[1])):
        if which == 1:
            joined = tail is not None and alike(tail, group)
            if joined:
                carries.append((pid, *held))
        else:
            held = [x + y for x, y in zip(held, values, strict=True)] if joined and whole_one else list(values)
            tail = group
    before = placed.sparkSession.createDataFrame(carries, StructType([StructField("_q", LongType())] + [StructField(f"_c{i}", LongType() if c in whole else DoubleType()) for i, c in enumerate(columns)]))
    joined = placed.filter("_mark is null").join(F.broadcast(before), (F.col("_p") == F.col("_q")) & (F.col("_head") == 1), "left")
    return joined.select(*df.columns, *[(F.col(f"_s{i}") + F.coalesce(f"_c{i}", F.lit(0))).alias(n) for i, n in enumerate(names)])
