"""Queries of curation: sources, projections, filters, aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replicata.functions.numbers import argmax_class, no_nan, p_scale, predict_binding
from replicata.operators import curate, frames
from replicata.queries.registry import Registry
from replicata.sources import catalog, files
from replicata.sources.tables import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def assay(spark: SparkSession, d: str) -> DataFrame:
    """Line items as replicates of a part: ``key, value, relation, id, date``."""
    rel = F.when(F.col("l_returnflag") == "A", ">").when(F.col("l_returnflag") == "R", "<").otherwise("")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("value"), rel.alias("relation"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("id"), F.col("l_shipdate").alias("date"))


def assay_unmixed(spark: SparkSession, d: str) -> DataFrame:
    """Replicates with one relation per key."""
    return assay(spark, d).withColumn("relation", F.element_at(F.array(F.lit(""), F.lit("<"), F.lit(">")), (F.col("key") % 3 + 1).cast("int")))


def sparse_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Mean quantity per part and flag as three tasks, each missing for a quarter of the parts: ``key, ta, tn, tr``."""
    t = lambda flag, k: F.when((F.col("l_partkey") + k) % 4 != 0, F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(t("A", 0).alias("ta"), t("N", 1).alias("tn"), t("R", 2).alias("tr")).withColumnRenamed("l_partkey", "key")


ASSAY = "assay AS (SELECT l_partkey AS key, l_quantity AS value, CASE l_returnflag WHEN 'A' THEN '>' WHEN 'R' THEN '<' ELSE '' END AS relation, l_orderkey || '_' || l_linenumber AS id, l_shipdate AS date FROM lineitem)"
UNMIXED = ASSAY + ", unmixed AS (SELECT key, value, id, date, CASE key % 3 WHEN 0 THEN '' WHEN 1 THEN '<' ELSE '>' END AS relation FROM assay)"
SPARSE = "sparse AS (SELECT l_partkey AS key, CASE WHEN (l_partkey + 0) % 4 <> 0 THEN avg(l_quantity) FILTER (WHERE l_returnflag = 'A') END AS ta, CASE WHEN (l_partkey + 1) % 4 <> 0 THEN avg(l_quantity) FILTER (WHERE l_returnflag = 'N') END AS tn, CASE WHEN (l_partkey + 2) % 4 <> 0 THEN avg(l_quantity) FILTER (WHERE l_returnflag = 'R') END AS tr FROM lineitem GROUP BY l_partkey)"
HTR = "htr3a_dtc_smiles_curated"


# Sources


@R.query("SELECT rec_id, compound_id, pic50 FROM htr3a_dtc_smiles_curated")
def scan_assay(spark, d):
    return files.scan(spark, f"{d}/{HTR}.parquet", columns=["rec_id", "compound_id", "pic50"])


@R.query("SELECT rec_id, source, 'NA' AS assay_site FROM htr3a_dtc_smiles_curated")
def scan_columns(spark, d):
    return catalog.columns_or_na(table(spark, d, HTR), ["rec_id", "source", "assay_site"])


@R.query("SELECT DISTINCT base_rdkit_smiles FROM htr3a_dtc_smiles_curated WHERE base_rdkit_smiles IS NOT NULL AND base_rdkit_smiles NOT IN (SELECT base_rdkit_smiles FROM htr3a_dtc_smiles_curated WHERE source = 'dossier_a' AND base_rdkit_smiles IS NOT NULL)")
def featurized_coverage(spark, d):
    t = table(spark, d, HTR)
    return files.uncovered(t, t.filter("source = 'dossier_a'"), "base_rdkit_smiles")


@R.query("SELECT rec_id, pic50 AS value, CASE WHEN active = 0 THEN '<' ELSE '' END AS relation FROM htr3a_dtc_smiles_curated WHERE pic50 IS NOT NULL AND isfinite(pic50) AND active IS NOT NULL AND source IN ('litmine', 'dossier_a')")
def source_flagged(spark, d):
    return files.flagged_source(table(spark, d, HTR), "rec_id", "pic50", F.col("active") == 0, F.col("source").isin("litmine", "dossier_a") & F.col("active").isNotNull())


@R.query("SELECT event_id, user_id AS key, round(-log10(value / 1e9), 6) AS pvalue FROM events WHERE event_type IN ('purchase', 'click') AND user_id IS NOT NULL AND value > 0")
def source_units(spark, d):
    p = frames.potency_source(table(spark, d, "events"), "user_id", "value", "event_type", ["purchase", "click"], "pvalue", "event_id")
    return p.withColumn("pvalue", r6(F.col("pvalue"), "pvalue"))


@R.query("SELECT event_id, 'k' AS field, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def source_json_explode(spark, d):
    return files.explode_json_map(table(spark, d, "events"), "props", "map<string,bigint>", ["event_id"], "field", "n")


# Projections


@R.query(r"""WITH x AS (SELECT rec_id, trim(replace(coalesce(relation, ''), '''', '')) AS r FROM htr3a_dtc_smiles_curated)
SELECT rec_id, CASE WHEN r IN ('>', '>=', '>>') THEN '>' WHEN r IN ('<', '<=', '<<') THEN '<' ELSE '=' END AS relation FROM x WHERE r IN ('', '>', '>=', '>>', '<', '<=', '<<', '=', '==', '~', '@')""")
def standardize_relations(spark, d):
    return curate.standardize_relations(table(spark, d, HTR), "relation").select("rec_id", "relation")


@R.query("SELECT event_id, round(-log10(value / (CASE WHEN event_type IN ('click', 'view') THEN 1e6 ELSE 1e9 END)), 6) AS p, CASE event_type WHEN 'click' THEN '>' WHEN 'view' THEN '<' ELSE '=' END AS relation FROM events WHERE value > 0")
def neg_log_response(spark, d):
    t = table(spark, d, "events")
    rel = F.when(F.col("event_type") == "click", "<").when(F.col("event_type") == "view", ">").otherwise("=")
    u = t.withColumn("unit", F.when(F.col("event_type").isin("click", "view"), "uM").otherwise("nM")).withColumn("relation", rel)
    return curate.neg_log_response(u, "value", "unit", "relation", "p").select("event_id", r6(F.col("p"), "p"), "relation")


@R.query("SELECT event_id, round(-log10(value / 1e9), 6) AS pxc50 FROM events")
def pxc50(spark, d):
    return frames.with_p_scale(table(spark, d, "events"), "value", "pxc50").select("event_id", r6(F.col("pxc50"), "pxc50"))


@R.query("SELECT rec_id, CASE WHEN isnan(pic50) THEN NULL ELSE (pic50 > 5)::INT + (pic50 > 6.5)::INT END AS class FROM htr3a_dtc_smiles_curated")
def classify_thresholds(spark, d):
    return curate.classify_column(table(spark, d, HTR), "pic50", [6.5, 5.0], "class").select("rec_id", "class")


@R.query("SELECT o_orderkey AS id, o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey, o_totalprice / 2 FROM orders WHERE o_orderstatus = 'F'")
def extra_results_unpivot(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 2).alias("extra"))
    return curate.stack_extra_result(o, "v", "extra")


@R.query("SELECT p_partkey, [p_size::DOUBLE, p_retailprice] AS features FROM part")
def assemble_features(spark, d):
    return frames.feature_array(table(spark, d, "part"), ["p_size", "p_retailprice"]).select("p_partkey", "features")


@R.query(f"WITH {SPARSE} SELECT key, [(ta IS NOT NULL)::INT::DOUBLE, (tn IS NOT NULL)::INT::DOUBLE, (tr IS NOT NULL)::INT::DOUBLE] AS w FROM sparse")
def make_weights(spark, d):
    return sparse_tasks(spark, d).select("key", curate.make_weights(["ta", "tn", "tr"])[1].alias("w"))


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS price_per_unit, l_tax / l_quantity AS tax_per_unit FROM lineitem")
def scale_per_unit(spark, d):
    per = frames.per_unit(table(spark, d, "lineitem"), {"price_per_unit": "l_extendedprice", "tax_per_unit": "l_tax"}, "l_quantity")
    return per.select("l_orderkey", "l_linenumber", "l_partkey", "price_per_unit", "tax_per_unit")


@R.query("SELECT l_partkey AS id, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 7) AS a_pred, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 7) AS n_pred, round(stddev_pop(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 7) AS a_std, round(stddev_pop(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 7) AS n_std FROM lineitem GROUP BY 1")
def prediction_frame(spark, d):
    long = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.lower("l_returnflag").alias("task"), F.col("l_extendedprice").alias("p"))
    wide = frames.wide_predictions(long, "id", "task", "p", ["a", "n"])
    return wide.select("id", *[F.round(c, 7).alias(c) for c in ("a_pred", "n_pred", "a_std", "n_std")])


@R.query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey AS id, CASE WHEN o_totalprice > 50000 THEN o_totalprice * 2 END AS pred FROM orders")
def predict_order_restore(spark, d):
    from replicata.operators import joins

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return joins.restore_order(o, "id", o.filter("o_totalprice > 50000").select("id", (F.col("o_totalprice") * 2).alias("pred")), ["pred"])


@R.query("SELECT l_partkey AS model, UNNEST(['mae', 'n']) AS metric, UNNEST([round(avg(abs(l_extendedprice - 20000)), 7), count(*)::DOUBLE]) AS score FROM lineitem GROUP BY l_partkey")
def explode_task_metrics(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("model")).agg(F.array(F.lit("mae"), F.lit("n")).alias("metric"), F.array(F.round(F.avg(F.abs(F.col("l_extendedprice") - 20000)), 7), F.count("*").cast("double")).alias("score"))
    return frames.explode_lists(g, ["model"], "metric", "score")


@R.query("SELECT row_id, 'train' AS term, best_train_r2_score AS score FROM pred_df UNION ALL SELECT row_id, 'valid', best_valid_r2_score FROM pred_df UNION ALL SELECT row_id, 'test', best_test_r2_score FROM pred_df")
def melt_terms(spark, d):
    return frames.melt(table(spark, d, "pred_df"), ["row_id"], {s: f"best_{s}_r2_score" for s in ("train", "valid", "test")})


@R.query("""WITH x AS (SELECT row_id, list_transform(string_split(layer_sizes, ','), lambda v: v::INT) AS l FROM pred_df WHERE layer_sizes IS NOT NULL)
SELECT row_id, len(l)::INT AS n_layers, round(list_avg(l), 6) AS mean_size, list_aggregate(l, 'product')::BIGINT AS product FROM x""")
def layer_stats(spark, d):
    p = frames.list_numbers(table(spark, d, "pred_df").filter("layer_sizes is not null").select("row_id", "layer_sizes"), "layer_sizes", "l")
    return frames.list_stats(p, "l").select("row_id", "n_layers", r6(F.col("mean_size"), "mean_size"), "product")


# Filters


@R.query("SELECT rec_id FROM htr3a_dtc_smiles_curated WHERE source IN ('litmine', 'rescreen')")
def filter_in(spark, d):
    return curate.filter_values(table(spark, d, HTR), "source", ["litmine", "rescreen"], True).select("rec_id")


@R.query("SELECT rec_id FROM htr3a_dtc_smiles_curated WHERE source IS NULL OR source NOT IN ('litmine', 'rescreen')")
def filter_out(spark, d):
    return curate.filter_values(table(spark, d, HTR), "source", ["litmine", "rescreen"], False).select("rec_id")


@R.query("SELECT doc_id FROM documents WHERE text IS NULL OR NOT (contains(lower(text), 'outlier') OR contains(text, 'Barcode')) OR contains(lower(text), 'nan') OR text = ' '")
def filter_comments(spark, d):
    return curate.filter_comments(table(spark, d, "documents"), "text", ["Outlier"], ["Barcode"]).select("doc_id")


@R.query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def down_select(spark, d):
    return curate.down_select(table(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 3})


@R.query("SELECT rec_id FROM htr3a_dtc_smiles_curated WHERE relation IS DISTINCT FROM '~' AND series_id IS NOT NULL AND pic50 IS NOT NULL AND source IN ('dossier_a', 'dossier_b')")
def eligible_rows(spark, d):
    return frames.eligible(table(spark, d, HTR), "relation", "~", ["series_id", "pic50"], "source", ["dossier_a", "dossier_b"]).select("rec_id")


@R.query("SELECT row_id FROM pred_df WHERE NOT (" + " OR ".join(f"coalesce(isinf({c}), false)" for c in ["model_choice_score", *[f"best_{s}_{m}_score" for s in ("train", "valid", "test") for m in ("r2", "rms", "mae")]]) + ")")
def drop_inf(spark, d):
    return curate.drop_inf(table(spark, d, "pred_df")).select("row_id")


@R.query("SELECT p_partkey, p_retailprice BETWEEN 1000 AND 1500 AND p_size BETWEEN 5 AND 40 AS kept FROM part")
def range_filter(spark, d):
    keep, reject = curate.with_rejects(table(spark, d, "part"), F.col("p_retailprice").between(1000, 1500) & F.col("p_size").between(5, 40))
    return keep.select("p_partkey", F.lit(True).alias("kept")).unionByName(reject.select("p_partkey", F.lit(False).alias("kept")))


@R.query("SELECT rec_id, coalesce(length(base_rdkit_smiles) > 0 AND pic50 IS NOT NULL AND NOT isnan(pic50), false) AS kept FROM htr3a_dtc_smiles_curated")
def drop_na_with_rejects(spark, d):
    keep, reject = curate.with_rejects(table(spark, d, HTR), (F.length("base_rdkit_smiles") > 0) & no_nan(F.col("pic50")).isNotNull())
    return keep.select("rec_id", F.lit(True).alias("kept")).unionByName(reject.select("rec_id", F.lit(False).alias("kept")))


@R.query("SELECT rec_id, compound_id FROM htr3a_dtc_smiles_curated QUALIFY count(*) OVER (PARTITION BY compound_id) = 1")
def remove_all_dupes(spark, d):
    return curate.remove_all_duplicates(table(spark, d, HTR), ["compound_id"]).select("rec_id", "compound_id")


@R.query(f"SELECT * FROM {HTR} ORDER BY ('0x' || substr(md5(concat_ws('|', rec_id, 17)), 1, 15))::BIGINT, rec_id LIMIT 1000")
def cap_rows(spark, d):
    return curate.cap_rows(table(spark, d, HTR), "rec_id", 1000, seed=17)


@R.query("SELECT reg_id, split_uuid FROM split_registry WHERE splitter IN ('scaffold', 'random')")
def catalog_search(spark, d):
    return catalog.search(catalog.as_catalog(table(spark, d, "split_registry"), ["reg_id", "split_uuid"], ["splitter", "split_strategy"]), "splitter", ["scaffold", "random"]).select("reg_id", "split_uuid")


# Aggregations


@R.query(f"""WITH {UNMIXED}, g AS (SELECT key, min(id) AS compound_id, min(date) AS date, CASE min(relation) WHEN '<' THEN min(value) WHEN '>' THEN max(value) ELSE avg(value) END AS value, min(relation) AS relation FROM unmixed GROUP BY key),
t AS (SELECT min(value) AS t FROM g WHERE relation = '<')
SELECT compound_id, key AS base_key, relation, round(value, 6) AS value, date, (relation <> '<' AND value > t)::INT AS active FROM g, t""")
def aggregate_assay(spark, d):
    out = curate.aggregate_assay(assay_unmixed(spark, d), "key", "value", "relation", "id", "date")
    return out.withColumn("value", F.round("value", 6))


@R.query(f"WITH {ASSAY} SELECT id, key, value, (relation <> '<' AND value > (SELECT min(value) FROM assay WHERE relation = '<'))::INT AS active FROM assay")
def label_actives(spark, d):
    return curate.label_actives(assay(spark, d), "value", "relation").select("id", "key", "value", "active")


@R.query()
def censored_mean(spark, d):
    a = assay(spark, d)
    return curate.censored_means(a, "key", "value", "relation", curate.replicate_rmsd(a, "key", "value", "relation"))


@R.query(f"""WITH {UNMIXED}, u AS (SELECT DISTINCT key, value, relation FROM unmixed)
SELECT key, CASE min(relation) WHEN '<' THEN min(value) WHEN '>' THEN max(value) ELSE round(avg(value), 6) END AS value, min(relation) AS relation FROM u GROUP BY key""")
def union_aggregate(spark, d):
    a = assay_unmixed(spark, d).select("key", "value", "relation")
    u = frames.union_aggregate([a.filter("value < 20"), a.filter("value >= 20 and value < 35"), a.filter("value >= 35")], "key", "value", "relation")
    return u.select("key", F.round("value", 6).alias("value"), "relation")


@R.query(f"WITH {ASSAY}, g AS (SELECT count(*) AS n, var_pop(value) AS v FROM assay WHERE relation = '' GROUP BY key HAVING count(*) > 1) SELECT round(coalesce(sqrt(sum(n * v) / sum(n)), 1.0), 6) AS rmsd FROM g")
def replicate_rmsd(spark, d):
    return curate.replicate_rmsd(assay(spark, d), "key", "value", "relation").select(r6(F.col("rmsd"), "rmsd"))


@R.query()
def remove_bad_duplicates(spark, d):
    return curate.remove_bad_duplicates(assay(spark, d), "key", "value", 75.0, 14.0)


@R.query(f"""WITH {ASSAY}, m AS (SELECT *, median(value) OVER (PARTITION BY key) AS m, count(*) OVER (PARTITION BY key) AS n FROM assay) SELECT id, key, value FROM m WHERE n = 1 OR abs(value - m) <= 10""")
def remove_outliers(spark, d):
    return curate.remove_outliers(assay(spark, d), "key", "value", 10.0).select("id", "key", "value")


@R.query("SELECT source AS value, count(*) AS count FROM htr3a_dtc_smiles_curated GROUP BY 1 HAVING count(*) >= 20")
def freq_table(spark, d):
    return curate.freq_table(table(spark, d, HTR), "source", 20)


@R.query("SELECT n_nationkey, count(*) AS count, min(n_name) AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def labeled_freq_table(spark, d):
    j = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return curate.labeled_freq_table(j, ["n_nationkey", "n_name"])


_SUM = "count(*) AS n_rows, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q75, max(v) AS max"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "median", "q75")})


@R.query(f"SELECT {_SUM} FROM (SELECT CASE WHEN isnan(pic50) OR isinf(pic50) THEN NULL ELSE pic50 END AS v FROM htr3a_dtc_smiles_curated WHERE pic50 IS NULL OR NOT isinf(pic50))")
def summarize(spark, d):
    return _rounded(curate.summarize(curate.drop_inf(table(spark, d, HTR)), "pic50"))


@R.query(f"SELECT l_returnflag, {_SUM} FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem) GROUP BY 1")
def summarize_many(spark, d):
    return _rounded(curate.summarize(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@R.query("""SELECT 'several keys' AS problem, compound_id AS id, count(DISTINCT base_rdkit_smiles) AS n FROM htr3a_dtc_smiles_curated WHERE compound_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT base_rdkit_smiles) > 1
UNION ALL SELECT 'missing key', compound_id, count(*) FROM htr3a_dtc_smiles_curated WHERE base_rdkit_smiles IS NULL GROUP BY 2
UNION ALL SELECT 'missing id', NULL, count(*) FROM htr3a_dtc_smiles_curated WHERE compound_id IS NULL HAVING count(*) > 0""")
def many_to_one_violations(spark, d):
    return curate.many_to_one_violations(table(spark, d, HTR), "compound_id", "base_rdkit_smiles")


@R.query("SELECT c.i::INT AS class, count(e.label) AS count FROM range(12) c(i) LEFT JOIN embeddings e ON e.label = c.i GROUP BY 1")
def class_freqs(spark, d):
    return curate.class_freqs(table(spark, d, "embeddings"), "label", 12)


@R.query("""WITH e AS (SELECT vec_id % 3 AS subset, label FROM embeddings) SELECT subset, list_sort(list(DISTINCT label)) AS classes, bool_and(label >= 0 AND label < 10) AS in_range, list_sort(list(DISTINCT label)) = (SELECT list_sort(list(DISTINCT label)) FROM e) AS complete FROM e GROUP BY 1""")
def class_sets(spark, d):
    return curate.class_sets(table(spark, d, "embeddings").withColumn("subset", F.col("vec_id") % 3), "subset", "label", 10).select("subset", "classes", "in_range", "complete")


@R.query(f"""WITH {SPARSE} SELECT (key % 50) AS k, min(key) AS key, (sum((ta IS NOT NULL)::INT) > 0)::INT::DOUBLE AS wa, (sum((tn IS NOT NULL)::INT) > 0)::INT::DOUBLE AS wn FROM sparse GROUP BY 1""")
def compact_weights(spark, d):
    s = sparse_tasks(spark, d).select((F.col("key") % 50).alias("k"), "key", F.col("key").alias("o"), F.col("ta").isNotNull().cast("double").alias("wa"), F.col("tn").isNotNull().cast("double").alias("wn"))
    return curate.compact(s, "k", "o", "key", ["wa", "wn"]).drop("o")


@R.query("SELECT count(*) > count(DISTINCT base_rdkit_smiles) AS has_dupes FROM htr3a_dtc_smiles_curated WHERE base_rdkit_smiles IS NOT NULL")
def has_dupes(spark, d):
    return frames.has_duplicates(table(spark, d, HTR), "base_rdkit_smiles")


@R.query("SELECT count(DISTINCT p_partkey) AS keys, count(DISTINCT (p_size, p_brand)) AS features, count(DISTINCT p_partkey) <> count(DISTINCT (p_size, p_brand)) AS collides FROM part")
def feature_collisions(spark, d):
    return frames.collisions(table(spark, d, "part"), "p_partkey", ["p_size", "p_brand"])


@R.query(f"WITH {SPARSE} SELECT key % 37 AS scaffold, count(ta) AS wa, count(tn) AS wn, count(tr) AS wr FROM sparse GROUP BY 1")
def scaffold_hist(spark, d):
    return frames.group_weights(sparse_tasks(spark, d), F.col("key") % 37, "scaffold", {"wa": "ta", "wn": "tn", "wr": "tr"})


@R.query("SELECT subset, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM (SELECT CASE WHEN lower(trim(subset)) IN ('train', 'valid', 'test') THEN lower(trim(subset)) END AS subset FROM split_table) WHERE subset IS NOT NULL GROUP BY 1")
def split_fractions(spark, d):
    from replicata.functions.keys import subset_form

    g = table(spark, d, "split_table").groupBy(subset_form(F.col("subset")).alias("subset")).agg(F.count("*").alias("n")).filter("subset is not null")
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).select("subset", "n", r6(F.col("n") / F.col("total"), "fraction"))


@R.query("SELECT source, round(100 * avg(active), 6) AS pct_active FROM htr3a_dtc_smiles_curated WHERE source IS NOT NULL GROUP BY 1")
def pct_active(spark, d):
    return frames.percent_active(table(spark, d, HTR), "source", "active").select("source", r6(F.col("pct_active"), "pct_active"))


@R.query("SELECT source, count(DISTINCT compound_id) AS compounds, count(*) AS n FROM htr3a_dtc_smiles_curated GROUP BY 1")
def value_counts(spark, d):
    return frames.distinct_counts(table(spark, d, HTR), "source", "compound_id", "compounds")


def _members(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("p"), (F.col("l_quantity") / 10).alias("s"))


for _how, _agg in {"mean": "avg(l_extendedprice)", "median": "median(l_extendedprice)", "max": "max(l_extendedprice)", "min": "min(l_extendedprice)", "weighted": "sum(l_extendedprice / (l_quantity / 10)) / sum(1 / (l_quantity / 10))"}.items():

    @R.query(f"SELECT l_partkey AS id, round({_agg}, 7) AS pred FROM lineitem GROUP BY 1", name=f"ensemble_{_how}")
    def _ensemble(spark, d, how=_how):
        return curate.ensemble(_members(spark, d), "id", "p", how, "s").select("id", F.round("pred", 7).alias("pred"))


# Scalars


@R.query(r"SELECT rec_id, replace(replace(trim(coalesce(relation, '')), '''', ''), '\"', '') AS relation, lower(trim(compound_id)) AS id FROM htr3a_dtc_smiles_curated".replace(r"\"", '"'))
def string_cleanup(spark, d):
    return table(spark, d, HTR).select("rec_id", F.regexp_replace(F.trim(F.coalesce("relation", F.lit(""))), "['\"]", "").alias("relation"), F.lower(F.trim("compound_id")).alias("id"))


@R.query("SELECT rec_id, translate(relation, '<>', '><') AS relation FROM htr3a_dtc_smiles_curated")
def translate_relation(spark, d):
    return table(spark, d, HTR).select("rec_id", F.translate("relation", "<>", "><").alias("relation"))


@R.query("SELECT event_id, round(1.0e0 / (1.0e0 + pow(10.0e0, 9.0e0 - value / 50) * 2.0e0 / 100), 6) AS bound FROM events")
def predict_binding_query(spark, d):
    return table(spark, d, "events").select("event_id", r6(predict_binding(F.col("value") / 50, F.lit(100.0), 2.0), "bound"))


R._queries["predict_binding"], R._sql["predict_binding"] = R._queries.pop("predict_binding_query"), R._sql.pop("predict_binding_query")  # noqa: SLF001


@R.query("SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS class FROM embeddings", name="argmax_class")
def _argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", argmax_class(F.col("embedding")).alias("class"))


@R.query("SELECT reg_id, coalesce(splitter, 'none') AS splitter, 'yes' AS checked, 2 + (splitter IS NOT NULL)::INT AS n_keys FROM split_registry")
def catalog_map_update(spark, d):
    c = catalog.as_catalog(table(spark, d, "split_registry"), ["reg_id"], ["splitter", "split_strategy"])
    u = catalog.update(c, {"checked": "yes"})
    return u.select("reg_id", F.coalesce(F.try_element_at("metadata", F.lit("splitter")), F.lit("none")).alias("splitter"), F.element_at("metadata", "checked").alias("checked"), F.size("metadata").alias("n_keys"))


@R.query("SELECT row_id, json_extract_string(model_parameters_dict, '$.max_epochs') AS max_epochs FROM pred_df")
def json_params(spark, d):
    return table(spark, d, "pred_df").select("row_id", F.get_json_object("model_parameters_dict", "$.max_epochs").alias("max_epochs"))


@R.query("SELECT doc_id, md5(text) AS checksum FROM documents WHERE text IS NOT NULL")
def md5_rows(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5("text").alias("checksum"))


@R.query("SELECT p_partkey, p_size <= 30 AND p_retailprice <= 1500 AS lipinski_like, p_retailprice BETWEEN 950 AND 1400 AND p_size BETWEEN 10 AND 45 AS ghose_like FROM part")
def drug_likeness_rules(spark, d):
    from replicata.functions.slots import within

    return table(spark, d, "part").select("p_partkey", within({"p_size": (None, 30), "p_retailprice": (None, 1500)}).alias("lipinski_like"), within({"p_retailprice": (950, 1400), "p_size": (10, 45)}).alias("ghose_like"))
