"""Problem 5: schemas that drift between files.

Each file is one version of its series' schema.  A version is profiled into fields with a type and a value sketch;
versions are compared in order, and the fields that went are matched with those that came by a bipartite matching
over equal types and sketches, with the similarity of names as weight.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replicata.plans.range_scan import range_sorted
from replicata.plans.skew import join_per_key
from replicata.plans.storage import materialize, release

CHANGES = "series_id bigint, file_id bigint, change_type string, field string, new_field string"
_IGNORED = "comment"


def _refuse(_: str) -> None:
    raise ValueError("not JSON")


class Literal(float):
    """A number that remembers how it was written."""

    __slots__ = ("text",)

    def __new__(cls, text: str) -> Literal:
        out = super().__new__(cls, text)
        out.text = text
        return out


def flatten(body: str | None) -> dict[str, tuple[str, object]] | None:
    """Fields of a JSON text as ``name -> (type, value)``; None if it is not valid JSON.

    Fields inside an object are ``object.field``; the object itself is no field.  Of a repeated field the last stays; ``comment``
    is left out.  Valid JSON that is no object has no fields.
    """
    if body is None:
        return None
    try:
        tree = json.loads(body, parse_constant=_refuse, parse_float=Literal)
    except (ValueError, RecursionError):
        return None
    out: dict[str, tuple[str, object]] = {}
    todo = [("", tree)] if isinstance(tree, dict) else []
    while todo:
        prefix, node = todo.pop()
        for k, v in node.items():
            if k == _IGNORED:
                continue
            if isinstance(v, dict):
                todo.append((f"{prefix}{k}.", v))
            else:
                out[prefix + k] = (json_type(v), v)
    return out


def json_type(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "list" if isinstance(v, list) else "text"


def _plain(v: object) -> object:
    """Numbers that are equal get one spelling."""
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return [_plain(x) for x in v] if isinstance(v, list) else v


def written(v: object) -> str:
    """JSON text of a value with its numbers as they were written; only blanks between elements are made uniform."""
    if isinstance(v, Literal):
        return v.text
    if isinstance(v, list):
        return "[" + ", ".join(map(written, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {written(x)}" for k, x in v.items()) + "}"
    return json.dumps(v, ensure_ascii=False)


def elements(v: object) -> list[str] | None:
    """The one type that values of all types have in common: a list of texts; a text is its only element, as it is, and null stays null."""
    if v is None:
        return None
    return [x if isinstance(x, str) else written(x) for x in (v if isinstance(v, list) else [v])]


def value_sketch(v: object) -> str:
    """A 64-bit sketch of one value; equal values have equal sketches."""
    return hashlib.blake2b(json.dumps(_plain(v), sort_keys=True).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two names, without letter case."""

    def pairs(s: str) -> set[str]:
        s = f" {s.lower()} "
        return {s[i : i + 2] for i in range(len(s) - 1)}

    x, y = pairs(a), pairs(b)
    return 2 * len(x & y) / (len(x) + len(y))


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """Matching of largest total weight between rows and columns (Hungarian method, O(n^2 m)); -inf forbids a pair.

    Allowed weights count at least 1 each, so that more pairs always beat a better fit of fewer.
    """
    n, m = weight.shape
    if n > m:
        return [(i, j) for j, i in assign(weight.T)]
    allowed = np.isfinite(weight)
    big = (n + m + 1.0) * 4
    cost = np.where(allowed, -(np.where(allowed, weight, 0) / (n + m + 1) + 1), big)
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = int(np.argmin(np.where(used, np.inf, least)))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j] and allowed[match[j] - 1, j - 1])


def match_fields(gone: list[tuple[str, str]], come: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Renames between ``(name, profile)`` lists: profiles must be equal, names decide among several."""
    gone, come = sorted(gone), sorted(come)
    by: dict[str, tuple[list[str], list[str]]] = {}
    for side, fields in enumerate((gone, come)):
        for name, profile in fields:
            by.setdefault(profile, ([], []))[side].append(name)
    out = []
    for old, new in by.values():
        if len(old) == len(new) == 1:
            out.append((old[0], new[0]))
        elif old and new:
            w = np.array([[name_similarity(a, b) for b in new] for a in old])
            out += [(old[i], new[j]) for i, j in assign(w)]
    return out


def differences(old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str, str]]:
    """``(change_type, field, new_field)`` between two versions ``name -> 'type:sketch'``."""
    gone, come = [(k, v) for k, v in old.items() if k not in new], [(k, v) for k, v in new.items() if k not in old]
    renamed = match_fields(gone, come)
    lost, won = {a for a, _ in renamed}, {b for _, b in renamed}
    out = [("renamed", a, b) for a, b in renamed]
    out += [("removed", k, "") for k, _ in gone if k not in lost]
    out += [("added", k, "") for k, _ in come if k not in won]
    for k, v in new.items():
        if k in old:
            a, b = old[k].split(":")[0], v.split(":")[0]
            if a != b and "null" not in (a, b):
                out.append(("retyped", k, ""))
    return out


_VERSION = "series_id bigint, written_at timestamp_ntz, file_id bigint, fields string"
_DIFF = CHANGES + ", edge string, pid int, is_tail boolean"
_ENTRIES = "array<struct<field: string, json_type: string, elements: array<string>>>"
_ENTRY = pa.list_(pa.struct([("field", pa.string()), ("json_type", pa.string()), ("elements", pa.list_(pa.string()))]))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per valid body: the columns beside it, names with types and sketches, and where asked for (an empty column ``entries``) all values."""
    for b in batches:
        parsed = [flatten(x) for x in b.column("body").to_pylist()]
        keep = pa.array([i for i, f in enumerate(parsed) if f is not None], pa.int64())
        valid = [f for f in parsed if f is not None]
        out = {c: b.column(c).take(keep) for c in b.schema.names if c not in ("body", "entries")}
        out["fields"] = pa.array([json.dumps({k: f"{t}:{value_sketch(v)}" for k, (t, v) in f.items()}) for f in valid], pa.string())
        if "entries" in b.schema.names:
            out["entries"] = pa.array([[{"field": k, "json_type": t, "elements": elements(v)} for k, (t, v) in sorted(f.items())] for f in valid], _ENTRY)
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _diff_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes inside a sorted partition; its first and last versions come out as edges (``edge`` holds the fields)."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _DIFF.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
    last = None
    for b in batches:
        rows = []
        for series, file, text in zip(*(b.column(c).to_pylist() for c in ("series_id", "file_id", "fields")), strict=True):
            fields = json.loads(text)
            if last is None:
                rows.append((series, file, None, None, None, text, pid, False))
            elif last[0] == series:
                rows += [(series, file, *d, None, pid, None) for d in differences(last[2], fields)]
            last = (series, file, fields, text)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((last[0], last[1], None, None, None, last[3], pid, True), types, strict=True)], names)


def _diff_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for series, file, old, new in zip(*(b.column(c).to_pylist() for c in ("series_id", "file_id", "old", "new")), strict=True):
            rows += [(series, file, *d) for d in differences(json.loads(old), json.loads(new))]
        if rows:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["series_id", "file_id", "change_type", "field", "new_field"])


def schema_changes(files: DataFrame) -> DataFrame:
    """Every field added, removed, renamed or retyped between consecutive files of a series.

    ``files``: ``series_id, file_id, written_at, body`` (JSON text).  Order in a series: ``written_at`` (nulls first), then
    ``file_id``.  Null and invalid bodies and rows with a null series are left out; a series' first file changes nothing;
    repeated rows change nothing.  Returns the columns of ``CHANGES``.

    Bodies shrink to names, types and 64-bit sketches, which are written once, before the one range-partitioned sort (whose bounds are sampled
    from what was written); a series of any size spreads over partitions, and only the two outermost versions of each partition are compared
    across (two rows a partition).
    """
    bodies = files.filter("series_id is not null and body is not null").select("series_id", "written_at", "file_id", "body")
    return _changes(materialize(bodies.mapInArrow(_profile, _VERSION)))


def _changes(versions: DataFrame) -> DataFrame:
    """The changes between written versions; those with a null series are left out."""
    versions = versions.filter("series_id is not null").select("series_id", "written_at", "file_id", "fields")
    scanned = materialize(range_sorted(versions, "series_id", "written_at", "file_id").mapInArrow(_diff_sorted, _DIFF))
    w = Window.partitionBy("series_id").orderBy("pid", "is_tail")
    edges = scanned.filter("edge is not null").withColumn("old", F.lag("edge").over(w))
    across = edges.filter("not is_tail and old is not null").select("series_id", "file_id", "old", F.col("edge").alias("new")).mapInArrow(_diff_edges, CHANGES)
    return scanned.filter("edge is null").select("series_id", "file_id", "change_type", "field", "new_field").unionByName(across)


_FIELDS = "file_id bigint, family string, field string, json_type string, value string, sketch string"


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [x.split()[0] for x in _FIELDS.split(", ")], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for file, family, body in zip(*(b.column(c).to_pylist() for c in ("file_id", "family", "body")), strict=True):
            for k, (t, v) in (flatten(body) or {}).items():
                rows.append((file, family, k, t, v if t == "text" else None if v is None else written(v), value_sketch(v)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def file_fields(files: DataFrame) -> DataFrame:
    """One row per file and field: ``file_id, family, field, json_type, value, sketch``; invalid bodies give none."""
    return files.filter("body is not null").select("file_id", "family", "body").mapInArrow(_explode, _FIELDS)


def field_profile(fields: DataFrame) -> DataFrame:
    """Profile of every field of a family: files, types seen, nulls, estimated distinct values (HyperLogLog over sketches)."""
    n = lambda t: F.count_if(F.col("json_type") == t).alias(f"n_{t}")
    return fields.groupBy("family", "field").agg(F.count("*").alias("n_files"), *[n(t) for t in ("text", "number", "boolean", "list", "null")], F.approx_count_distinct("sketch").alias("distinct_values"))


def _with_family(rows: DataFrame, per_family: DataFrame) -> DataFrame:
    """``rows`` with the row that ``per_family`` has for their family, nulls if none; a family with very many rows is dealt to several tasks."""
    key = F.concat(F.lit("f"), F.col("family"))
    keyed = rows.withColumn("_f", F.coalesce(key, F.lit("n")))
    sizes = keyed.groupBy("_f").agg(F.count("*").alias("_n"))
    one = materialize(sizes.join(per_family.withColumn("_f", F.coalesce(key, F.lit("n"))).drop("family"), "_f", "left"))
    return join_per_key(keyed, one, ["_f"], "_n").drop("_f")


def canonical_fields(entries: DataFrame, renames: DataFrame, together: float = 0.5) -> DataFrame:
    """``family, field, canonical``: fields of a family that renames connect get the name most of its files use (ties: the smaller name).

    ``entries``: ``family, names`` (the field names of one file); ``renames``: ``family, field, new_field``.  Two names of one thing are not used
    side by side: a rename between names that stand together in more than the share ``together`` of the files of the rarer one is an accident of
    equal values and connects nothing.  The share is of all files, so that the size of the data decides nothing.  Null families are a family.

    The vocabulary of field names is what is connected here, not the files: the edges are distinct pairs of names, and
    labels spread along them by joins until nothing changes.
    """
    uses = materialize(entries.select("family", F.explode("names").alias("field")).groupBy("family", "field").agg(F.count("*").alias("n")))
    pairs = renames.select("family", F.least("field", "new_field").alias("a"), F.greatest("field", "new_field").alias("b")).distinct()
    partners = materialize(pairs.groupBy("family", "a").agg(F.collect_set("b").alias("bs")))
    per_family = partners.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("a", "bs"))).alias("_partners"))
    candidates = _with_family(entries, per_family).select("family", "names", F.explode(F.filter("names", lambda x: F.map_contains_key("_partners", x))).alias("a"), "_partners")
    met = candidates.select("family", "a", F.explode(F.array_intersect("names", F.try_element_at("_partners", F.col("a")))).alias("b")).groupBy("family", "a", "b").agg(F.count("*").alias("both"))

    def beside(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
        same = F.col("l.family").eqNullSafe(F.col("r.family"))
        for p, q in on.items():
            same = same & (F.col(f"l.{p}") == F.col(f"r.{q}"))
        drop = {"family", *on.values()}
        return left.alias("l").join(right.alias("r"), same, how).select("l.*", *[f"r.{c}" for c in right.columns if c not in drop])

    known = partners.select("family", "a", F.explode("bs").alias("b"))
    rated = beside(beside(beside(known, uses.withColumnRenamed("n", "na"), {"a": "field"}), uses.withColumnRenamed("n", "nb"), {"b": "field"}), met, {"a": "a", "b": "b"}, "left")
    kept = rated.filter(F.coalesce("both", F.lit(0)) <= F.lit(together) * F.least("na", "nb")).select("family", "a", "b")
    edges = materialize(kept.unionByName(kept.select("family", F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialize(uses.select("family", "field", F.struct((-F.col("n")).alias("r"), F.col("field").alias("name")).alias("best")))
    release(partners)
    while True:
        near = beside(edges, labels, {"b": "field"}).groupBy("family", "a").agg(F.min("best").alias("near"))
        nxt = materialize(beside(labels, near, {"field": "a"}, "left").select("family", "field", F.least("best", F.coalesce("near", "best")).alias("best"), (F.col("near") < F.col("best")).alias("moved")))
        more = not nxt.filter("moved").isEmpty()
        release(labels)
        labels = nxt
        if not more:
            return labels.select("family", "field", F.col("best.name").alias("canonical"))


def unified_table(files: DataFrame, wanted: list[str]) -> DataFrame:
    """All valid files as one table: ``file_id, series_id, family, written_at``, one column for each canonical field in ``wanted``, ``others``, a
    map of all that these columns do not hold, and ``conflicts``.

    A field renamed anywhere in its family is read under its canonical name.  Types are unified to lists of texts: a list gives its elements, any
    other value itself as its only element, as it was written; null stays null.  If a file has several fields of one canonical name, the field
    that bears it wins, then the smaller name; the others stay in ``others`` under their own names and are named in ``conflicts``.  A wanted name
    that is not canonical in a family stands for the canonical name of its group there.  No field is lost: one that is not canonical is the
    canonical name of no group.  Repeated rows of a file come out repeatedly.

    Bodies are parsed once and written with their fields; the map of its family's renamed fields is joined to each row.
    Files without any field come out too, with nulls.
    """
    source = files.filter("body is not null").select("series_id", "written_at", "file_id", "family", "body", F.lit(None).cast(_ENTRIES).alias("entries"))
    versions = materialize(source.mapInArrow(_profile, "series_id bigint, written_at timestamp_ntz, file_id bigint, family string, fields string, entries " + _ENTRIES))
    family = versions.filter("series_id is not null").select("series_id", "file_id", "family").distinct()
    renames = _changes(versions).filter("change_type = 'renamed'").join(family, ["series_id", "file_id"]).select("family", "field", "new_field")
    canon = canonical_fields(versions.select("family", F.transform("entries", lambda e: e["field"]).alias("names")), renames)
    names = F.map_from_entries(F.filter(F.collect_list(F.struct("field", "canonical")), lambda x: x["field"] != x["canonical"]))
    read = _with_family(versions, canon.groupBy("family").agg(names.alias("_names")))

    def place(e: Column) -> Column:
        c = F.coalesce(F.try_element_at("_names", e["field"]), e["field"])
        return F.struct(c.alias("canonical"), (e["field"] != c).alias("other"), e["field"].alias("field"), e["elements"].alias("elements"))

    # Sorted, a group's best field stands first.
    read = read.withColumn("_every", F.sort_array(F.transform("entries", place)))
    best = F.filter("_every", lambda x, i: (i == 0) | ~F.get("_every", i - 1)["canonical"].eqNullSafe(x["canonical"]))
    rest = F.filter("_every", lambda x, i: (i > 0) & F.get("_every", i - 1)["canonical"].eqNullSafe(x["canonical"]))
    asked = F.array(*[F.coalesce(F.try_element_at("_names", F.lit(w)), F.lit(w)) for w in wanted]).cast("array<string>")
    # Maps, so that no field is looked for among all others once per column.
    held = F.map_from_entries(F.transform("_best", lambda x: F.struct(x["canonical"].alias("key"), x["elements"].alias("value"))))
    read = read.withColumns({"_best": best, "_rest": rest, "_asked": asked}).withColumn("_held", held)
    pick = [F.try_element_at("_held", F.get("_asked", F.lit(i))).alias(w) for i, w in enumerate(wanted)]
    beyond = F.map_entries(F.map_filter("_held", lambda k, _: ~F.array_contains("_asked", k)))
    others = F.map_from_entries(F.concat(beyond, F.transform("_rest", lambda x: F.struct(x["field"].alias("key"), x["elements"].alias("value")))))
    return read.select("file_id", "series_id", "family", "written_at", *pick, others.alias("others"), F.transform("_rest", lambda x: x["field"]).alias("conflicts"))
