"""File sources and sinks: scans by extension, coverage checks, split tables, sources of several shapes (SRC)."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replicata.functions.numbers import is_inf, no_nan

_DRIVER_BYTES = 256 << 20  # formats that only the driver can read are refused beyond this size


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, id_col: str | None = None, schema: str | None = None, sep: str = ",", nrows: int | None = None) -> DataFrame:
    """SRC1, SRC2: a table by its extension: parquet, csv, tsv (also .gz and .bz2), json, feather, pickle; identifiers become text.

    Feather and pickle files are read by the driver and refused above a size limit.  ``nrows``: only so many rows.
    """
    base = path.lower().rstrip("/")
    for z in (".gz", ".bz2", ".tgz"):
        base = base.removesuffix(z)
    kind = os.path.splitext(base)[1]
    if kind in (".csv", ".tsv", ".txt"):
        reader = spark.read.option("header", True).option("sep", "\t" if kind == ".tsv" else sep)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    elif kind == ".parquet" or not kind:
        df = spark.read.parquet(path)
    elif kind == ".orc":
        df = spark.read.orc(path)
    elif kind in (".json", ".jsonl"):
        df = spark.read.option("multiLine", kind == ".json").json(path)
    elif kind in (".feather", ".pkl", ".xls", ".xlsx"):
        if os.path.getsize(path) > _DRIVER_BYTES:
            raise ValueError(f"{path} is larger than {_DRIVER_BYTES} bytes; convert it to parquet")
        read = {".feather": pd.read_feather, ".pkl": pd.read_pickle}.get(kind, pd.read_excel)
        df = spark.createDataFrame(read(path))
    else:
        raise ValueError(f"unknown format: {path}")
    if columns:
        df = df.select(*columns)
    if id_col:
        df = df.withColumn(id_col, F.col(id_col).cast("string"))
    return df.limit(nrows) if nrows is not None else df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """SRC5: raises for an empty table."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def uncovered(data: DataFrame, featurized: DataFrame, key: str) -> DataFrame:
    """SRC6: distinct keys of ``data`` without features; missing keys are left out."""
    return data.filter(F.col(key).isNotNull()).select(key).distinct().join(featurized.select(key), key, "left_anti")


def save_if_absent(df: DataFrame, path: str) -> None:
    """SRC7: writes parquet unless something is there already."""
    df.write.mode("ignore").parquet(path)


def split_path(folder: str, dataset: str, prefix: str, uuid: str) -> str:
    """SRC8: where a split table lies."""
    return f"{folder}/{dataset}_{prefix}_{uuid}"


def save_split(df: DataFrame, folder: str, dataset: str, prefix: str, uuid: str) -> None:
    df.write.mode("overwrite").partitionBy("subset").parquet(split_path(folder, dataset, prefix, uuid))


def load_split(spark: SparkSession, folder: str, dataset: str, prefix: str, uuid: str) -> DataFrame:
    return spark.read.parquet(split_path(folder, dataset, prefix, uuid))


def flagged_source(df: DataFrame, identifier: str, value: str, censored: Column, keep: Column) -> DataFrame:
    """SRC11: rows with a finite value: ``identifier, value, relation`` with ``<`` where ``censored`` holds."""
    v = no_nan(F.col(value))
    return df.filter(keep & v.isNotNull() & ~is_inf(F.col(value))).select(identifier, v.alias("value"), F.when(censored, "<").otherwise("").alias("relation"))


def explode_json_map(df: DataFrame, column: str, schema: str, keep: list[str], key: str, value: str) -> DataFrame:
    """SRC13: the entries of a JSON object in rows; broken JSON and null values give none."""
    m = F.from_json(F.col(column), schema)
    return df.select(*keep, F.explode(m).alias(key, value)).filter(F.col(value).isNotNull())


def explode_parallel(df: DataFrame, column: str, schema: str, keep: list[str], arrays: list[str]) -> DataFrame:
    """SRC13: a JSON object of objects with parallel arrays in rows: target, compound, then the arrays' elements side by side."""
    outer = df.select(*keep, F.explode(F.from_json(F.col(column), f"map<string,map<string,struct<{schema}>>>")).alias("target", "c"))
    inner = outer.select(*keep, "target", F.explode("c").alias("compound", "s"))
    return inner.select(*keep, "target", "compound", F.inline(F.arrays_zip(*[F.col(f"s.{a}").alias(a) for a in arrays])))


def registry_documents(spark: SparkSession, folder: str, name: str = "model_metadata.json") -> DataFrame:
    """SRC9: all documents of a name below a folder, with the path of each as ``path``."""
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(folder)
    return docs.select("*", F.col("_metadata.file_path").alias("path"))


def archived_documents(spark: SparkSession, folder: str, member: str = "model_metadata.json", pattern: str = "*.tar.gz") -> DataFrame:
    """SRC10: a member of every tar archive below a folder: ``path, document`` (null if it is missing or broken)."""
    import io
    import tarfile

    from pyspark.sql.types import StringType

    def run(s: pd.Series) -> pd.Series:
        def one(b: bytes) -> str | None:
            try:
                with tarfile.open(fileobj=io.BytesIO(b)) as t:
                    return next((t.extractfile(m).read().decode() for m in t if os.path.basename(m.name) == member), None)
            except (tarfile.TarError, OSError, UnicodeDecodeError):
                return None

        return s.map(one)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.pandas_udf(run, StringType())("content").alias("document"))


def log_timings(spark: SparkSession, path: str, pattern: str = r"(\d+) days?, (\d+):(\d+):(\d+)") -> DataFrame:
    """SRC17: durations found in logs: ``path, seconds`` of each first match of days, hours, minutes and seconds."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    g = lambda i: F.regexp_extract("value", pattern, i).cast("bigint")
    return t.filter(F.col("value").rlike(pattern)).select("path", (g(1) * 86400 + g(2) * 3600 + g(3) * 60 + g(4)).alias("seconds"))


def fetch(spark: SparkSession, catalog: DataFrame, dataset_key: str | None = None, object_id: str | None = None, **options) -> DataFrame | dict[str, DataFrame]:
    """SRC2, SRC3: the table of a catalogue record (``dataset_key, object_id, path``) by its key or its object id.

    Archives of folders give a table per file, sheets of a workbook a table per sheet.  Raises if no record or more than one fits.
    """
    want = {"dataset_key": dataset_key, "object_id": object_id}
    for k, v in want.items():
        if v is not None:
            catalog = catalog.filter(F.col(k) == v)
    found = catalog.select("path").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} record for {want}")
    path = found[0].path
    if path.lower().endswith((".tar.gz", ".tgz", ".tar", ".zip")):
        return archived_tables(spark, path, **options)
    if path.lower().endswith((".xls", ".xlsx")):
        if os.path.getsize(path) > _DRIVER_BYTES:
            raise ValueError(f"{path} is larger than {_DRIVER_BYTES} bytes; convert it to parquet")
        return {k: spark.createDataFrame(v) for k, v in pd.read_excel(path, sheet_name=None).items()}
    return scan(spark, path, **options)


def archived_tables(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """SRC2: every table of an archive, unpacked into the shared folder once; members that would leave it are refused."""
    import tarfile
    import uuid
    import zipfile

    from replicata.plans.storage import shared_folder

    target = f"{shared_folder(spark).removeprefix('file://')}/archive-{uuid.uuid4().hex}"
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
            if any(n.startswith("/") or ".." in n.split("/") for n in names):
                raise ValueError("a member leaves the archive's folder")
            z.extractall(target)
    else:
        with tarfile.open(path) as t:
            names = [m.name for m in t if m.isfile()]
            t.extractall(target, filter="data")
    kinds = (".csv", ".tsv", ".txt", ".parquet", ".json", ".jsonl", ".orc", ".feather", ".pkl", ".csv.gz", ".csv.bz2")
    return {n: scan(spark, f"{target}/{n}", **options) for n in names if n.lower().endswith(kinds)}
