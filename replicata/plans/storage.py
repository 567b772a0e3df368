"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "replicata-"


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one named by ``spark.checkpoint.dir``; where that is unset (tests, local mode), below a new local one.

    The folder is removed when the driver ends, with all tables that were not released before.
    """
    folder = spark.conf.get("spark.replicata.folder", None)
    if folder:
        return folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix=_PREFIX)
        base = "file://" + path
        import atexit

        atexit.register(shutil.rmtree, path, ignore_errors=True)
    folder = f"{base.rstrip('/')}/{_PREFIX}{spark.sparkContext.applicationId}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    spark.conf.set("spark.replicata.folder", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage of ``df``: writes it once as Parquet into the shared folder and reads it back.

    Unlike a plain re-execution the result is one fixed set of rows, so it can be read several times even when
    the plan above it has sampled range bounds.  Executors can be lost at any time; the files stay.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{_PREFIX}{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._replicata_path = path  # noqa: SLF001 - lets release() find it
    return out


def release(df: DataFrame | None) -> None:
    """Deletes the files of a materialized DataFrame that nothing reads any more."""
    path = getattr(df, "_replicata_path", None)
    if path is None:
        return
    jvm = df.sparkSession.sparkContext._jvm  # noqa: SLF001
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before costly Python work: as it is when its scan has enough partitions, else dealt out round-robin.

    A large table has more splits than cores and is left alone; only a table of a few files is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
