from conftest import rows

from replicata.operators.curate import censored_means
from replicata.streaming.curation import curate_stream

SCHEMA = "k string, v double, r string"


def test_stream_equals_batch(spark, tmp_path):
    data = [(f"k{i % 7}", float(i % 5), ["", "<", ">"][i % 3]) for i in range(60)] + [(None, 1.0, ""), ("k1", float("nan"), "")]
    src = str(tmp_path / "in")
    for part in (data[:20], data[20:45], data[45:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        curate_stream(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp"), "k", "v", "r", 0.5, buckets=3).awaitTermination(120)
    batch = censored_means(spark.createDataFrame(data, SCHEMA), "k", "v", "r", spark.createDataFrame([(0.5,)], "rmsd double"))
    got = spark.read.parquet(str(tmp_path / "out")).select("key", "relation", "value")
    near = lambda df: [(k, r, round(v, 9)) for k, r, v in rows(df)]
    assert near(got) == near(batch.select("key", "relation", "value"))
