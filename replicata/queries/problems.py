"""The pN_ queries of the problems in the core: references (1) and schema drift (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replicata.functions.keys import key_form
from replicata.operators import drift, references
from replicata.sources.tables import table


def _references(spark: SparkSession, d: str) -> DataFrame:
    """All references as ``ref_table, row_id, key, at``; the key's first letter tells its kind of parent."""

    def refs(name: str, kind: str, key: str, at: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("ref_table"), "row_id", F.concat(F.lit(kind), key_form(F.col(key))).alias("key"), F.col(at).alias("at"))

    return refs("split_table", "c", "cmpd_id", "assigned_at").unionByName(refs("pred_df", "s", "split_uuid", "time_built")).unionByName(refs("reg_config_h1_fit_gcnmodel", "s", "split_uuid", "written_at"))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    def parents(name: str, kind: str, key: str, start: str, end: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(kind), key_form(F.col(key))).alias("key"), F.col(start).alias("start"), F.col(end).alias("end"))

    return parents("htr3a_dtc_smiles_curated", "c", "compound_id", "loaded_at", "retracted_at").unionByName(parents("split_registry", "s", "split_uuid", "created_at", "deleted_at"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose target did not exist when they were made."""
    return references.orphan_references(_references(spark, d), _parents(spark, d)).select("ref_table", "row_id")


def p1_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month, by reason, beside all references of that month."""
    month = F.date_trunc("month", F.col("at").cast("timestamp")).cast("date").alias("month")
    lost = references.orphan_references(_references(spark, d), _parents(spark, d)).groupBy("ref_table", month).agg(F.count_if(F.col("reason") == "ended").alias("ended"), F.count_if(F.col("reason") == "not_yet").alias("not_yet"))
    made = _references(spark, d).filter("key is not null").groupBy("ref_table", month).agg(F.count("*").alias("made"))
    a, b = made.alias("a"), lost.alias("b")
    return a.join(b, (F.col("a.ref_table") == F.col("b.ref_table")) & F.col("a.month").eqNullSafe(F.col("b.month")), "left").select("a.ref_table", "a.month", "made", F.coalesce("ended", F.lit(0)).alias("ended"), F.coalesce("not_yet", F.lit(0)).alias("not_yet"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field between consecutive files of a series."""
    return drift.schema_changes(table(spark, d, "reg_config_raw"))


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every file with its type."""
    return drift.file_fields(table(spark, d, "reg_config_raw")).select("file_id", "family", "field", "json_type")


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Types, nulls and estimated distinct values of every field of a family of files."""
    return drift.field_profile(drift.file_fields(table(spark, d, "reg_config_raw")))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    """The config files as one table under canonical field names."""
    return drift.unified_table(table(spark, d, "reg_config_raw"), ["parser_version", "dataset_key", "split_uuid", "response_cols", "featurizer", "model_type", "max_epochs", "layer_sizes", "PytrochMPNNModel_mode", "GCNModel_mode", "GCNModel_learning_rate"])


_KEY = "nullif(regexp_replace(lower({}), '[^a-z0-9]', '', 'g'), '')"
_P1_REFS = f"""
refs AS (SELECT 'split_table' AS ref_table, row_id, 'c' || {_KEY.format('cmpd_id')} AS k, assigned_at AS made_at FROM split_table
 UNION ALL SELECT 'pred_df', row_id, 's' || {_KEY.format('split_uuid')}, time_built FROM pred_df
 UNION ALL SELECT 'reg_config_h1_fit_gcnmodel', row_id, 's' || {_KEY.format('split_uuid')}, written_at FROM reg_config_h1_fit_gcnmodel),
parents AS (SELECT 'c' || {_KEY.format('compound_id')} AS k, loaded_at AS s, retracted_at AS e FROM htr3a_dtc_smiles_curated
 UNION ALL SELECT 's' || {_KEY.format('split_uuid')}, created_at, deleted_at FROM split_registry)
"""
_P1 = f"WITH {_P1_REFS} SELECT ref_table, row_id FROM refs WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.k = refs.k AND p.s <= refs.made_at AND (p.e IS NULL OR p.e > refs.made_at))"
_P1_MONTH = f"""WITH {_P1_REFS},
state AS (SELECT r.*, bool_or(p.s <= r.made_at AND (p.e IS NULL OR p.e > r.made_at)) AS alive, bool_or(p.s <= r.made_at AND (p.e IS NULL OR p.e > p.s)) AS seen
  FROM refs r LEFT JOIN parents p ON p.k = r.k WHERE r.k IS NOT NULL GROUP BY ALL)
SELECT ref_table, date_trunc('month', made_at)::DATE AS month, count(*) AS made, count(*) FILTER (WHERE NOT coalesce(alive, false) AND coalesce(seen, false)) AS ended,
 count(*) FILTER (WHERE NOT coalesce(alive, false) AND NOT coalesce(seen, false)) AS not_yet FROM state GROUP BY ALL"""

_FLAT = """
valid AS (SELECT series_id, file_id, family, written_at, CASE WHEN json_valid(body) THEN body::JSON END AS b FROM reg_config_raw WHERE body IS NOT NULL AND json_valid(body)),
tree(file_id, name, typ, val, place) AS (
 SELECT file_id, j.key, j.type, j.value, j.id FROM valid, json_each(CASE WHEN json_type(b) = 'OBJECT' THEN b ELSE '{}'::JSON END) j WHERE j.key <> 'comment'
 UNION ALL SELECT file_id, name || '.' || j.key, j.type, j.value, j.id FROM tree, json_each(CASE WHEN typ = 'OBJECT' THEN val ELSE '{}'::JSON END) j WHERE typ = 'OBJECT' AND j.key <> 'comment'),
leaf AS (SELECT file_id, name, CASE WHEN typ = 'VARCHAR' THEN 'text' WHEN typ = 'BOOLEAN' THEN 'boolean' WHEN typ = 'NULL' THEN 'null' WHEN typ = 'ARRAY' THEN 'list' ELSE 'number' END AS t, val
 FROM tree WHERE typ <> 'OBJECT' QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY place DESC) = 1)
"""
# Equal values pair in the order of names here; the operator lets the likeness of names decide, which the tests cover.
_P5 = f"""WITH RECURSIVE {_FLAT},
steps AS (SELECT series_id, file_id, lag(file_id) OVER (PARTITION BY series_id ORDER BY written_at NULLS FIRST, file_id) AS old FROM valid WHERE series_id IS NOT NULL),
profile AS (SELECT file_id, name, t, t || ':' || CASE WHEN t = 'number' THEN (val::VARCHAR)::DOUBLE::VARCHAR ELSE val::VARCHAR END AS v FROM leaf),
gone AS (SELECT s.series_id, s.file_id, p.name, p.v FROM steps s JOIN profile p ON p.file_id = s.old WHERE NOT EXISTS (SELECT 1 FROM profile q WHERE q.file_id = s.file_id AND q.name = p.name)),
come AS (SELECT s.series_id, s.file_id, p.name, p.v FROM steps s JOIN profile p ON p.file_id = s.file_id WHERE s.old IS NOT NULL AND NOT EXISTS (SELECT 1 FROM profile q WHERE q.file_id = s.old AND q.name = p.name)),
og AS (SELECT *, row_number() OVER (PARTITION BY file_id, v ORDER BY name) AS i FROM gone), oc AS (SELECT *, row_number() OVER (PARTITION BY file_id, v ORDER BY name) AS i FROM come),
renamed AS (SELECT og.series_id, og.file_id, og.name AS field, oc.name AS new_field FROM og JOIN oc ON og.file_id = oc.file_id AND og.v = oc.v AND og.i = oc.i)
SELECT series_id, file_id, 'renamed' AS change_type, field, new_field FROM renamed
UNION ALL SELECT series_id, file_id, 'removed', name, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = g.file_id AND r.field = g.name)
UNION ALL SELECT series_id, file_id, 'added', name, '' FROM come c WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = c.file_id AND r.new_field = c.name)
UNION ALL SELECT s.series_id, s.file_id, 'retyped', p.name, '' FROM steps s JOIN profile p ON p.file_id = s.file_id JOIN profile q ON q.file_id = s.old AND q.name = p.name WHERE p.t <> q.t AND p.t <> 'null' AND q.t <> 'null'"""
_P5_FIELDS = f"WITH RECURSIVE {_FLAT} SELECT file_id, family, name AS field, t AS json_type FROM leaf JOIN valid USING (file_id)"


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_by_month, p5_found, p5_fields, p5_profile, p5_unified)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p1_by_month": _P1_MONTH, "p5_found": _P5, "p5_fields": _P5_FIELDS}
