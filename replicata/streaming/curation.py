"""Incremental curation: a stream of measurements is normalized as it comes, and only the keys it touches are aggregated anew.

An extension; the batch form is :func:`replicata.operators.curate.aggregate_assay`, whose result the stream reproduces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from replicata.functions.numbers import no_nan
from replicata.operators.curate import censored_means, neg_log_response, standardize_relations


def normalized(stream: DataFrame, value: str, unit: str, relation: str, out: str) -> DataFrame:
    """The stateless part: relations and units (PRJ1, PRJ2), for streams and tables alike."""
    return neg_log_response(standardize_relations(stream, relation), value, unit, relation, out)


def curate_stream(stream: DataFrame, store: str, results: str, checkpoint: str, key: str, value: str, relation: str, sigma: float, buckets: int = 16) -> StreamingQuery:
    """Appends each micro-batch to the replicate store and rewrites the results of the buckets that it touches.

    ``store`` and ``results`` are folders partitioned by a hash bucket of the key.  A batch that is delivered again replaces its own files, so
    every replicate counts once.  Missing keys and values drop out.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch.select(F.col(key).alias("key"), no_nan(F.col(value).cast("double")).alias("value"), F.col(relation).alias("relation")).dropna(subset=["key", "value"])
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={batch_id}")
            every = spark.read.option("basePath", store).parquet(f"{store}/batch=*").filter(F.col("bucket").isin(touched))
            one = spark.createDataFrame([(sigma,)], "rmsd double")
            means = censored_means(every, "key", "value", "relation", one).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
            means.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(results)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(stream: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows and mean value per window and kind; rows later than the watermark are left out."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, window), kind)
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
