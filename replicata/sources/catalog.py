"""The dataset catalogue: metadata as maps, searches, updates, tables with 'NA' for unknown columns (SRC4, SRC16, FIL13, FIL14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_or_na(df: DataFrame, columns: list[str], max_rows: int | None = None) -> DataFrame:
    """SRC4: the columns asked for; unknown ones hold ``NA`` in every row."""
    out = df.select(*[F.col(c) if c in df.columns else F.lit("NA").alias(c) for c in columns])
    return out.limit(max_rows) if max_rows is not None else out


def as_catalog(df: DataFrame, keep: list[str], keys: list[str]) -> DataFrame:
    """Records with a map ``metadata`` of the given columns as text; missing values have no entry."""
    m = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(k).cast("string") for k in keys])), lambda _, v: v.isNotNull())
    return df.select(*keep, m.alias("metadata"))


def from_key_values(c: Column) -> Column:
    """A list of ``{key, value}`` as a map; of repeated keys the last counts."""
    return F.aggregate(c, F.expr("map()").cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def search(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """FIL13: records whose metadata has one of the values under the key."""
    return df.filter(F.coalesce(F.try_element_at("metadata", F.lit(key)).isin(values), F.lit(False)))


def narrow(df: DataFrame, contains: dict[str, str]) -> DataFrame:
    """FIL14: records whose values contain the given texts."""
    for k, part in contains.items():
        df = df.filter(F.coalesce(F.contains(F.try_element_at("metadata", F.lit(k)), F.lit(part)), F.lit(False)))
    return df


def update(df: DataFrame, entries: dict[str, str], drop: list[str] | None = None) -> DataFrame:
    """Adds or replaces entries of the metadata, after dropping others."""
    gone = [*entries, *(drop or [])]
    kept = F.map_filter("metadata", lambda k, _: ~k.isin(gone))
    new = F.create_map(*[F.lit(x) for kv in entries.items() for x in kv]) if entries else None
    return df.withColumn("metadata", F.map_concat(kept, new) if entries else kept)


def keys(df: DataFrame) -> DataFrame:
    """All metadata keys, without repeats."""
    return df.select(F.explode(F.map_keys("metadata")).alias("key")).distinct()


def values_for_key(df: DataFrame, key: str) -> DataFrame:
    """SRT5: the values of a key, sorted without letter case."""
    v = df.select(F.try_element_at("metadata", F.lit(key)).alias("value")).filter("value is not null").distinct()
    return v.orderBy(F.lower("value"), "value")


def upload(df: DataFrame, name: str, metadata: dict[str, str], catalog_path: str, data_path: str) -> None:
    """SRC16: writes a table and its record into the catalogue."""
    df.write.mode("errorifexists").parquet(f"{data_path}/{name}")
    record = df.sparkSession.createDataFrame([(name, f"{data_path}/{name}", metadata)], "dataset_key string, path string, metadata map<string,string>")
    record.write.mode("append").parquet(catalog_path)
