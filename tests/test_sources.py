import io
import json
import tarfile

import pytest
from conftest import rows

from replicata.functions.slots import LIPINSKI, ngram_fingerprint, structure_slot, within
from replicata.sources import catalog, files
from pyspark.sql import functions as F


def test_scan_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    df.toPandas().to_csv(tmp_path / "t.csv", index=False)
    df.toPandas().to_csv(tmp_path / "t.tsv", index=False, sep="\t")
    df.toPandas().to_csv(tmp_path / "t.csv.bz2", index=False)
    df.toPandas().to_feather(tmp_path / "t.feather")
    df.write.parquet(str(tmp_path / "t.parquet"))
    for name in ("t.csv", "t.tsv", "t.csv.bz2", "t.feather", "t.parquet"):
        got = files.scan(spark, str(tmp_path / name), id_col="id")
        assert dict(got.dtypes)["id"] == "string" and sorted(r.id for r in got.collect()) == ["1", "2"], name
    assert files.scan(spark, str(tmp_path / "t.csv"), nrows=1).count() == 1
    with pytest.raises(ValueError, match="unknown format"):
        files.scan(spark, "x.abc")
    with pytest.raises(ValueError, match="no rows"):
        files.require_rows(df.limit(0), "table")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", 0), ("b", "test", 0)], "cmpd_id string, subset string, fold int")
    files.save_if_absent(df, str(tmp_path / "f"))
    files.save_if_absent(df.limit(0), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    files.save_split(df, str(tmp_path), "d", "p", "u")
    assert rows(files.load_split(spark, str(tmp_path), "d", "p", "u").select("cmpd_id", "subset", "fold")) == rows(df)


def test_registry_documents_and_archives(spark, tmp_path):
    doc = json.dumps({"model_uuid": "m1", "n": 3})
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "model_metadata.json").write_text(doc)
    with tarfile.open(tmp_path / "m.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("x/model_metadata.json")
        info.size = len(doc)
        t.addfile(info, io.BytesIO(doc.encode()))
    (tmp_path / "bad.tar.gz").write_bytes(b"nothing")
    assert files.registry_documents(spark, str(tmp_path)).first().model_uuid == "m1"
    got = {r.path.rsplit("/", 1)[1]: r.document for r in files.archived_documents(spark, str(tmp_path)).collect()}
    assert got == {"m.tar.gz": doc, "bad.tar.gz": None}


def test_logs_and_json(spark, tmp_path):
    (tmp_path / "l.out").write_text("start\ntook 1 day, 2:03:04\n")
    assert files.log_timings(spark, str(tmp_path / "l.out")).first().seconds == 93784
    df = spark.createDataFrame([(1, '{"t": {"c": {"p": [1, 2], "u": ["a", "b"]}}}'), (2, "broken"), (3, None)], "id int, j string")
    assert rows(files.explode_parallel(df, "j", "p array<int>, u array<string>", ["id"], ["p", "u"])) == [(1, "t", "c", 1, "a"), (1, "t", "c", 2, "b")]


def test_catalog(spark):
    c = catalog.as_catalog(spark.createDataFrame([(1, "B", "x"), (2, "a", None)], "id int, k string, z string"), ["id"], ["k", "z"])
    assert [r.id for r in catalog.search(c, "z", ["x"]).collect()] == [1]
    assert [r.value for r in catalog.values_for_key(c, "k").collect()] == ["a", "B"]
    assert rows(catalog.keys(c)) == [("k",), ("z",)]
    assert [r.id for r in catalog.narrow(c, {"k": "a"}).collect()] == [2]
    u = catalog.update(c, {"k": "new"}, drop=["z"]).collect()
    assert all(r.metadata == {"k": "new"} for r in u)
    kv = spark.createDataFrame([([{"key": "a", "value": "1"}, {"key": "a", "value": "2"}],)], "m array<struct<key:string,value:string>>")
    assert kv.select(catalog.from_key_values(F.col("m")).alias("m")).first().m == {"a": "2"}
    assert catalog.columns_or_na(c, ["id", "nope"]).first().nope == "NA"


def test_slots(spark):
    df = spark.createDataFrame([(" CC ",), (None,)], "s string")
    assert [r[0] for r in df.select(structure_slot()(F.col("s"))).collect()] == ["CC", ""]
    assert [r[0] for r in df.select(structure_slot(lambda x: x.strip() * 2)(F.col("s"))).collect()] == ["CCCC", ""]
    p = spark.createDataFrame([(400.0, 3.0, 1.0, 2.0), (600.0, 3.0, 1.0, 2.0), (None, 3.0, 1.0, 2.0)], "mol_weight double, logp double, h_donors double, h_acceptors double")
    assert [r[0] for r in p.select(within(LIPINSKI)).collect()] == [True, False, None]
    f = spark.createDataFrame([("abcd",), ("a",), (None,)], "s string").select(ngram_fingerprint(F.col("s")).alias("f")).collect()
    assert len(f[0].f) == 2 and f[1].f == [] and f[2].f is None
