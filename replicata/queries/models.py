"""Queries of joins, sets, splits, the registry, hyperparameters, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from replicata.functions.keys import subset_form
from replicata.operators import curate, distance, frames, joins, registry, splits
from replicata.queries.curation import SPARSE, r6, sparse_tasks
from replicata.queries.modelling import _EUC, _queries, _vectors
from replicata.queries.registry import Registry
from replicata.sources.tables import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def _split(spark, d):
    s = F.when(F.col("o_orderkey") % 10 < 8, "train").when(F.col("o_orderkey") % 10 == 8, "valid").otherwise("test")
    return table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), s.alias("subset"), (F.col("o_orderkey") % 5).alias("fold"), "o_orderdate", "o_totalprice")


_SPLIT = "s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'valid' ELSE 'test' END AS subset, o_orderkey % 5 AS fold, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus <> 'P')"

# Joins


@R.query(f"WITH {_SPLIT} SELECT l_orderkey AS id, l_quantity, subset, fold FROM lineitem LEFT JOIN s ON s.id = l_orderkey")
def label_split(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity")  # noqa: E741
    return joins.label_split(l, _split(spark, d), "id")


@R.query(f"WITH {_SPLIT} SELECT subset, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN s ON s.id = l_orderkey GROUP BY 1")
def join_split_inner(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity")  # noqa: E741
    return frames.inner_with(l, _split(spark, d), "id").groupBy("subset").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, p_size, p_retailprice FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10")
def join_descriptors(spark, d):
    p = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    return frames.lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), p, "l_partkey")


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size > 25 THEN p_retailprice ELSE l_partkey * 2.0 END AS feature FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def feature_cache_join(spark, d):
    known = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("feature"))
    return joins.compute_missing(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", known, lambda todo: todo.withColumn("feature", F.col("l_partkey") * F.lit(2.0)))


_MERGED = "m AS (SELECT c_nationkey AS key, c_name AS id, c_acctbal AS v FROM customer UNION ALL SELECT s_nationkey, s_name, s_acctbal FROM supplier)"
_MERGE_SQL = {"list": "list_sort(list(v))", "uniquelist": "list_sort(list(DISTINCT v))", "mean": "round(avg(v), 6)", "geomean": "round(exp(avg(CASE WHEN v > 0 THEN ln(v) END)), 4)", "median": "round(median(v), 6)", "max": "max(v)", "min": "min(v)", "mode": ""}
for _how, _sql in _MERGE_SQL.items():
    _q = f"WITH {_MERGED} SELECT key, min(id) AS id, {_sql} AS v FROM m GROUP BY 1" if _sql else f"WITH {_MERGED}, n AS (SELECT key, round(v / 1000) AS v, count(*) AS n FROM m GROUP BY 1, 2), i AS (SELECT key, min(id) AS id FROM m GROUP BY 1) SELECT key, id, v FROM n JOIN i USING (key) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, v) = 1"

    @R.query(_q, name=f"merge_sources_{_how}")
    def _merge(spark, d, how=_how):
        c = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("id"), F.col("c_acctbal").alias("v"))
        s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("id"), F.col("s_acctbal").alias("v"))
        if how == "mode":
            c, s = c.withColumn("v", F.round(F.col("v") / 1000)), s.withColumn("v", F.round(F.col("v") / 1000))
        m = joins.merge_sources([c, s], "key", "id", "v", how)
        return m.withColumn("v", F.round("v", 4 if how == "geomean" else 6)) if how in ("mean", "median", "geomean") else m


@R.query("SELECT DISTINCT c_nationkey AS key FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def shared_keys(spark, d):
    k = lambda t, c: table(spark, d, t).select(F.col(c).alias("key"))
    return joins.shared_keys([k("customer", "c_nationkey"), k("supplier", "s_nationkey"), table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("key"))], "key")


@R.query("SELECT s.s_suppkey, s.s_name, n.n_name AS structure FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey")
def attach_structures(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), frames.unquoted(F.col("n_name")).alias("structure"))
    return frames.inner_with(table(spark, d, "supplier"), n, "s_nationkey").select("s_suppkey", "s_name", "structure")


@R.query("SELECT row_id, model_choice_score, p.max_epochs FROM pred_df JOIN (SELECT row_id, json_extract_string(model_parameters_dict, '$.max_epochs') AS max_epochs FROM pred_df WHERE model_type = 'NN') p USING (row_id)")
def perf_param_join(spark, d):
    p = table(spark, d, "pred_df")
    params = p.filter("model_type = 'NN'").select("row_id", F.get_json_object("model_parameters_dict", "$.max_epochs").alias("max_epochs"))
    return frames.inner_with(p.select("row_id", "model_choice_score"), params, "row_id")


@R.query("SELECT coalesce(a.k, b.k) AS key, a.k IS NOT NULL AS in_perf, b.k IS NOT NULL AS in_files FROM (SELECT DISTINCT split_uuid AS k FROM pred_df WHERE split_uuid IS NOT NULL) a FULL JOIN (SELECT DISTINCT split_uuid AS k FROM split_registry) b ON a.k = b.k")
def perf_files_outer(spark, d):
    k = lambda t: table(spark, d, t).select(F.col("split_uuid").alias("key"))
    return frames.present_in(k("pred_df"), k("split_registry"), "key", "in_perf", "in_files")


@R.query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def select_by_ids(spark, d):
    ids = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return joins.select_by_ids(table(spark, d, "part"), ids, "p_partkey").select("p_partkey", "p_name")


@R.query("SELECT coalesce(a.k, b.k) AS key, qa, qr FROM (SELECT l_partkey AS k, max(l_quantity) AS qa FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, max(l_quantity) AS qr FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2 GROUP BY 1) b ON a.k = b.k")
def outer_merge_targets(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    a = l.filter("l_returnflag = 'A' and l_linenumber = 1").groupBy(F.col("l_partkey").alias("key")).agg(F.max("l_quantity").alias("qa"))
    r = l.filter("l_returnflag = 'R' and l_linenumber = 2").groupBy(F.col("l_partkey").alias("key")).agg(F.max("l_quantity").alias("qr"))
    return frames.outer_merge(a, r, ["key"])


# Sets


@R.query("SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def union_keys(spark, d):
    return frames.distinct_keys([(table(spark, d, t), c) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))])


@R.query("SELECT o_custkey AS key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def intersect_keys(spark, d):
    return joins.select_by_ids(table(spark, d, "orders").select(F.col("o_custkey").alias("key")), table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("key")), "key")


@R.query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def except_keys(spark, d):
    k = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("key"))
    return frames.keys_without(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), k, "key")


@R.query("SELECT 'customer' AS source, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier")
def union_sources(spark, d):
    return frames.stack_sources({n: (table(spark, d, n), {"name": f"{n[0]}_name", "balance": f"{n[0]}_acctbal"}) for n in ("customer", "supplier")})


@R.query(f"WITH {_SPLIT}, a AS (SELECT * FROM s WHERE o_totalprice > 60000), b AS (SELECT * FROM s WHERE o_totalprice < 400000), j AS (SELECT coalesce(a.subset, b.subset) AS subset, coalesce(a.fold, b.fold) AS fold, a.id AS i, b.id AS j FROM a FULL JOIN b ON a.id = b.id AND a.subset = b.subset AND a.fold = b.fold) SELECT subset, fold, count(i) AS n_a, count(j) AS n_b, count(*) FILTER (WHERE j IS NULL) AS only_a, count(*) FILTER (WHERE i IS NULL) AS only_b FROM j GROUP BY 1, 2")
def compare_splits(spark, d):
    s = _split(spark, d)
    return joins.compare_splits(s.filter("o_totalprice > 60000"), s.filter("o_totalprice < 400000"), "id")


@R.query(f"WITH {_SPLIT} SELECT DISTINCT id FROM s WHERE (fold = 0 AND subset IN ('train', 'valid')) OR (fold <> 0 AND subset = 'valid')")
def combined_training(spark, d):
    s = _split(spark, d)
    return joins.combined_training(s, "id", s.filter("fold <> 0 and subset = 'valid'"))


# Splits


@R.query("""WITH c AS (SELECT compound_id, min(rec_id) AS r FROM htr3a_dtc_smiles_curated GROUP BY 1), o AS (SELECT compound_id, row_number() OVER (ORDER BY r) - 1 AS i, count(*) OVER () AS n FROM c)
SELECT rec_id, compound_id FROM htr3a_dtc_smiles_curated WHERE compound_id IN (SELECT compound_id FROM o WHERE i < floor(n * 0.8 + 1e-9))""")
def expand_selection(spark, d):
    h = table(spark, d, "htr3a_dtc_smiles_curated").select("rec_id", "compound_id")
    c = curate.compact(h.withColumn("ordinal", F.col("rec_id")), "compound_id", "ordinal", "rec_id", [])
    return splits.expand_selection(h, "compound_id", splits.index_split(c.select("compound_id", "rec_id"), "rec_id", 0.1, 0.1).filter("subset = 'train'"))


@R.query("SELECT o_orderkey AS id, f.i::INT AS fold, CASE WHEN o_orderkey % 5 = f.i THEN 'valid' ELSE 'train' END AS subset FROM orders, range(5) f(i)")
def kfold_assign(spark, d):
    return splits.kfold(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), F.col("id"), 5)


@R.query("SELECT p_partkey, unnest(['train', 'valid', 'test']) AS subset FROM part")
def production_split(spark, d):
    return splits.production_split(table(spark, d, "part").select("p_partkey"))


_POS = "CASE WHEN r < floor(n * 0.8 + 1e-9) THEN 'train' WHEN r < floor(n * 0.9 + 1e-9) THEN 'valid' ELSE 'test' END"


@R.query(f"SELECT o_orderkey AS id, {_POS} AS subset FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)")
def index_split(spark, d):
    return splits.index_split(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 0.1, 0.1)


@R.query(f"SELECT rec_id, active, {_POS} AS subset FROM (SELECT rec_id, active, row_number() OVER (PARTITION BY active ORDER BY rec_id) - 1 AS r, count(*) OVER (PARTITION BY active) AS n FROM htr3a_dtc_smiles_curated)")
def stratified_split(spark, d):
    return splits.stratified_split(table(spark, d, "htr3a_dtc_smiles_curated").select("rec_id", "active"), "rec_id", "active", 0.1, 0.1)


_HASH = "('0x' || substr(md5(concat_ws('|', {})), 1, 15))::BIGINT"


@R.query(f"SELECT id, {_POS} AS subset FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY {_HASH.format('o_orderkey, 17')}, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)")
def random_split(spark, d):
    return splits.random_split(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 0.1, 0.1, 17)


_GREEDY = """WITH RECURSIVE g AS (SELECT series_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, series_id NULLS FIRST) AS i FROM htr3a_dtc_smiles_curated GROUP BY 1),
t AS (SELECT sum(n)::DOUBLE AS total FROM g),
f(i, tr, va, subset) AS (SELECT 0::BIGINT, 0::HUGEINT, 0::HUGEINT, NULL::VARCHAR
 UNION ALL SELECT g.i, CASE WHEN f.tr + g.n <= 0.8e0 * total + 1e-9 THEN f.tr + g.n ELSE f.tr END, CASE WHEN f.tr + g.n > 0.8e0 * total + 1e-9 AND f.tr + f.va + g.n <= 0.9e0 * total + 1e-9 THEN f.va + g.n ELSE f.va END,
 CASE WHEN f.tr + g.n <= 0.8e0 * total + 1e-9 THEN 'train' WHEN f.tr + f.va + g.n <= 0.9e0 * total + 1e-9 THEN 'valid' ELSE 'test' END FROM f JOIN g ON g.i = f.i + 1, t)
SELECT rec_id, h.series_id, subset FROM htr3a_dtc_smiles_curated h JOIN g ON g.series_id IS NOT DISTINCT FROM h.series_id JOIN f ON f.i = g.i"""


@R.query(_GREEDY)
def scaffold_split(spark, d):
    return splits.scaffold_split(table(spark, d, "htr3a_dtc_smiles_curated").select("rec_id", "series_id"), "series_id", 0.1, 0.1)


@R.query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT subset, fold::INT AS fold, count(*) AS n FROM (SELECT 'test' AS subset, f.i AS fold FROM o, range(5) f(i) WHERE r >= floor(n * 0.8 + 1e-9)) GROUP BY 1, 2")
def kfold_hold_out(spark, d):
    k = splits.kfold_split(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 0.2, 5)
    return k.filter("subset = 'test'").groupBy("subset", "fold").agg(F.count("*").alias("n"))


@R.query()
def cluster_folds(spark, d):
    f = splits.cluster_folds(table(spark, d, "htr3a_dtc_smiles_curated").select("rec_id", "series_id"), "series_id", 5)
    return f.select("rec_id", "fold")


@R.query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate AS date FROM orders), e AS (SELECT id, date, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM o WHERE date <= TIMESTAMP '1997-01-01')
SELECT id, CASE WHEN r < floor(n * 0.9 + 1e-9) THEN 'train' ELSE 'valid' END AS subset FROM e UNION ALL SELECT id, 'test' FROM o WHERE date > TIMESTAMP '1997-01-01'""")
def temporal_split(spark, d):
    import datetime

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"))
    return splits.temporal_split(o, "date", datetime.datetime(1997, 1, 1), "id", 0.1).select("id", "subset")


@R.query("SELECT row_id, CASE WHEN s = 'test' THEN 'test' WHEN fold = 1 THEN 'valid' ELSE 'train' END AS subset FROM (SELECT row_id, fold, lower(regexp_replace(subset, '^\\s+|\\s+$', '', 'g')) AS s FROM split_table) WHERE s IN ('train', 'valid', 'test')")
def presplit_folds(spark, d):
    s = table(spark, d, "split_table").select("row_id", "fold", subset_form(F.col("subset")).alias("subset")).filter("subset is not null")
    return splits.presplit_folds(s, 1).select("row_id", "subset")


@R.query()
def smush_scaffolds(spark, d):
    return splits.smush(table(spark, d, "htr3a_dtc_smiles_curated"), "series_id", 100)


@R.query()
def genetic_split(spark, d):
    """Series merged to 100 super-groups and split by the whole fitness; its far fractions compare the structures of all records with all."""
    from replicata.functions.slots import ngram_fingerprint
    from replicata.plans.storage import materialize

    h = table(spark, d, "htr3a_dtc_smiles_curated").select("rec_id", "series_id", "base_rdkit_smiles", "pic50", F.col("active").cast("double").alias("active"))
    per = materialize(splits.smush(h, "series_id", 100))
    rows = materialize(splits._join_groups(h, "series_id", per, "n"))
    masks = materialize(splits.structure_masks(rows, "rec_id", "super_group", "base_rdkit_smiles", F.lit(True), ngram_fingerprint, 0.3))
    best = splits.genetic_group_split(splits.group_histogram(rows, "super_group", ["pic50", "active"]), 100, 2, masks=masks, generations=15, population=30, seed=17)
    return best.select("group", "subset", *[r6(F.col(c), c) for c in ("fitness", "far_test", "far_valid", "ratio", "response")])


def _members(spark, d):
    s = F.when(F.col("id") % 20 != 0, "train").when(F.col("id") % 40 == 0, "valid").otherwise("test")
    return _vectors(spark, d).select("id", s.alias("subset"), (F.col("id") % 7).alias("scaffold"))


@R.query(f"WITH {_EUC}, near AS (SELECT DISTINCT query_id FROM p WHERE id % 20 <> 0 AND distance < 1.15) SELECT CASE WHEN id % 40 = 0 THEN 'valid' ELSE 'test' END AS subset, count(*) AS n, round(1 - count(near.query_id)::DOUBLE / count(*), 6) AS far_fraction FROM q LEFT JOIN near ON near.query_id = q.id GROUP BY 1")
def far_fraction(spark, d):
    pairs = distance.pair_distances(_queries(spark, d), _vectors(spark, d), "euclidean", 1.15).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "distance")
    f = splits.far_fraction(pairs, _members(spark, d), "id", 1.15)
    return f.select("subset", "n", r6(F.col("far_fraction"), "far_fraction"))


@R.query(f"WITH {_EUC} SELECT least(query_id % 7, id % 7) AS group_a, greatest(query_id % 7, id % 7) AS group_b, round(min(distance), 6) AS distance FROM p WHERE query_id % 7 <> id % 7 GROUP BY 1, 2")
def scaffold_min_dist(spark, d):
    pairs = distance.pair_distances(_queries(spark, d), _vectors(spark, d), "euclidean").select(F.col("query_id").alias("a"), F.col("id").alias("b"), "distance")
    return splits.group_min_distance(pairs, _members(spark, d), "id", "scaffold").withColumn("distance", F.round("distance", 6))


@R.query()
def ave_split(spark, d):
    """The split of blocks of vectors with the least asymmetric bias; every row meets every 20th one."""
    from replicata.plans.storage import materialize

    v = _vectors(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("active")), "id")
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(16)).cast("int")
    pairs = distance.pair_distances(_queries(spark, d), v.select("id", "v"), "euclidean").filter("query_id <> id")
    other = v.select("id", F.col("active").alias("b_active"), block("id").alias("b"))
    least = pairs.join(other, "id").groupBy("query_id", "b").agg(*[F.min(F.when(F.col("b_active") == y, F.col("distance") / 2)).alias(f"d{y}") for y in (1, 0)])
    wide = least.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("b", F.struct("d1", "d0")))).alias("m"))
    take = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.try_element_at("m", i)[c], F.lit(float("inf"))))
    near = wide.withColumnRenamed("query_id", "id").join(v.select("id", "active"), "id").select("id", "active", take("d1").alias("to_active"), take("d0").alias("to_inactive"))
    return splits.ave_minimize(materialize(near), "id", "active", 0.2, generations=8, population=16, blocks=16, seed=17).withColumn("bias", F.round("bias", 6))


_SUB = "CASE WHEN key % 10 < 8 THEN 'train' WHEN key % 10 = 8 THEN 'valid' ELSE 'test' END"


def _tasks_split(spark, d):
    return sparse_tasks(spark, d).withColumn("subset", F.when(F.col("key") % 10 < 8, "train").when(F.col("key") % 10 == 8, "valid").otherwise("test"))


@R.query(f"""WITH {SPARSE}, h AS (SELECT {_SUB} AS subset, count(ta)::DOUBLE / (SELECT count(ta) FROM sparse) AS a, count(tn)::DOUBLE / (SELECT count(tn) FROM sparse) AS n, count(tr)::DOUBLE / (SELECT count(tr) FROM sparse) AS r FROM sparse GROUP BY 1),
s AS (SELECT list_sort([a, n, r]) AS s, CASE subset WHEN 'train' THEN 0.8e0 ELSE 0.1e0 END AS w FROM h) SELECT round(1 - sqrt(sum(pow(w - s[1], 2) + pow(w - s[2], 2) + pow(w - s[3], 2))) / 3, 6) AS fitness FROM s""")
def ratio_fitness(spark, d):
    return splits.ratio_fitness(_tasks_split(spark, d), ["ta", "tn", "tr"], {"train": 0.8, "valid": 0.1, "test": 0.1}).select(r6(F.col("fitness"), "fitness"))


def _w1(a: str, b: str) -> str:
    return f"""(WITH u AS (SELECT ta AS v, 1.0e0 / count(*) OVER () AS wa, 0.0e0 AS wb FROM x WHERE subset = '{a}' AND ta IS NOT NULL UNION ALL SELECT ta, 0.0e0, 1.0e0 / count(*) OVER () FROM x WHERE subset = '{b}' AND ta IS NOT NULL),
g AS (SELECT v, sum(wa) AS wa, sum(wb) AS wb FROM u GROUP BY v), c AS (SELECT v, sum(wa) OVER w AS fa, sum(wb) OVER w AS fb, lead(v) OVER w AS nv FROM g WINDOW w AS (ORDER BY v)) SELECT sum(abs(fa - fb) * (nv - v)) FROM c)"""


@R.query(f"WITH {SPARSE}, x AS (SELECT ta, {_SUB} AS subset FROM sparse) SELECT round(1 - ({_w1('train', 'valid')} + {_w1('train', 'test')}) / 2, 6) AS fitness")
def response_fitness(spark, d):
    from replicata.plans.storage import materialize

    x = materialize(_tasks_split(spark, d).select("ta", "subset"))
    return spark.createDataFrame([(round(splits.response_fitness(x, ["ta"]), 6),)], "fitness double")


@R.query(f"""WITH {_EUC}, n AS (SELECT q.id, (l.label >= 5)::INT AS active, min(distance) FILTER (WHERE r.label >= 5) AS ta, min(distance) FILTER (WHERE r.label < 5) AS ti FROM p JOIN q ON q.id = query_id JOIN embeddings l ON l.vec_id = q.id JOIN embeddings r ON r.vec_id = p.id WHERE p.id % 20 <> 0 GROUP BY 1, 2),
s AS (SELECT active, CASE active WHEN 1 THEN ta ELSE ti END / 2 AS same, CASE active WHEN 1 THEN ti ELSE ta END / 2 AS other FROM n), t AS (SELECT i / 100.0e0 AS t FROM range(101) r(i)), f AS (SELECT active, t, avg((same <= t + 1e-11)::INT) AS fs, avg((other <= t + 1e-11)::INT) AS fo FROM s, t GROUP BY 1, 2)
SELECT round(sum(d), 6) AS bias FROM (SELECT active, avg(fs - fo) AS d FROM f GROUP BY 1)""")
def ave_bias(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("active"))
    train = _vectors(spark, d).filter("id % 20 <> 0").join(labels, "id")
    to = lambda a: distance.nearest(_queries(spark, d), train.filter(F.col("active") == a).select("id", "v"), 1, "euclidean").select(F.col("query_id").alias("id"), (F.col("distance") / 2).alias("to_active" if a else "to_inactive"))
    return splits.ave_bias(to(1).join(to(0), "id").join(labels, "id")).select(r6(F.col("bias"), "bias"))


# Registry


@R.query("SELECT row_id FROM pred_df WHERE model_type = 'RF' AND best_test_r2_score > 0.5 AND NOT isnan(best_test_r2_score) AND features IN ('ecfp', 'rdkit_raw') AND splitter <> 'random'")
def registry_filter(spark, d):
    return registry.match(curate_nan(table(spark, d, "pred_df")), {"model_type": "RF", "best_test_r2_score": [">", 0.5], "features": {"$in": ["ecfp", "rdkit_raw"]}, "splitter": ["!=", "random"]}).select("row_id")


def curate_nan(df):
    from replicata.functions.numbers import no_nan

    return df.withColumns({c: no_nan(F.col(c)) for c, t in df.dtypes if t == "double"})


@R.query("SELECT row_id, best_valid_num_compounds FROM pred_df WHERE model_type = 'NN' AND best_valid_num_compounds = (SELECT max(best_valid_num_compounds) FROM pred_df WHERE model_type = 'NN')")
def registry_max(spark, d):
    return registry.match(table(spark, d, "pred_df"), {"model_type": "NN", "best_valid_num_compounds": ["max", None]}).select("row_id", "best_valid_num_compounds")


@R.query("WITH a AS (SELECT * FROM pred_df WHERE best_test_num_compounds = (SELECT min(best_test_num_compounds) FROM pred_df)) SELECT row_id FROM a WHERE best_train_num_compounds = (SELECT max(best_train_num_compounds) FROM a)")
def registry_priority(spark, d):
    return registry.match(table(spark, d, "pred_df"), {"best_train_num_compounds": ["max", 2], "best_test_num_compounds": ["min", 1]}).select("row_id")


def _long_perf(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("model"), F.explode(F.array(F.lit("train"), F.lit("valid"), F.lit("test"))).alias("subset"), "p_retailprice", "p_size").filter("not (subset = 'test' and p_size % 10 = 0)").withColumn("r2", F.col("p_retailprice") / F.when(F.col("subset") == "train", 1000).when(F.col("subset") == "valid", 2000).otherwise(4000))


@R.query("SELECT p_partkey AS model, round(p_retailprice / 1000, 6) AS best_train_r2, round(p_retailprice / 2000, 6) AS best_valid_r2, round(p_retailprice / 4000, 6) AS best_test_r2 FROM part WHERE p_size % 10 <> 0")
def perf_table(spark, d):
    t = registry.perf_table(_long_perf(spark, d), "model", "subset", ["r2"])
    return t.select("model", *[r6(F.col(c), c) for c in ("best_train_r2", "best_valid_r2", "best_test_r2")])


@R.query("SELECT row_id, CASE WHEN split_strategy = 'k_fold_cv' THEN best_train_num_compounds + best_test_num_compounds ELSE best_train_num_compounds + best_valid_num_compounds + best_test_num_compounds END AS dataset_size FROM pred_df")
def perf_summary(spark, d):
    p = table(spark, d, "pred_df")
    return p.select("row_id", registry.dataset_size(p, "split_strategy", "best_train_num_compounds", "best_valid_num_compounds", "best_test_num_compounds").alias("dataset_size"))


@R.query("SELECT row_id, CASE WHEN isnan(model_choice_score) THEN NULL ELSE model_choice_score END AS score FROM pred_df")
def perf_sorted(spark, d):
    p = curate_nan(table(spark, d, "pred_df"))
    return frames.sort_by_score(p.select("row_id", F.col("model_choice_score").alias("score")), "score", "row_id")


@R.query("SELECT dataset_key, row_id, CASE WHEN best_valid_r2_score = 0 THEN 0.0 ELSE best_valid_r2_score END AS best_valid_r2_score FROM pred_df WHERE dataset_key IS NOT NULL AND best_valid_r2_score IS NOT NULL AND NOT isnan(best_valid_r2_score) QUALIFY row_number() OVER (PARTITION BY dataset_key ORDER BY best_valid_r2_score DESC, row_id) = 1")
def best_model(spark, d):
    return registry.best_model(table(spark, d, "pred_df"), ["dataset_key"], "best_valid_r2_score", "row_id")


@R.query("SELECT row_id, unnest(['train', 'valid', 'full_model']) AS task, unnest([best_train_r2_score, best_valid_r2_score, best_test_r2_score]) AS score FROM pred_df")
def multitask_perf(spark, d):
    p = table(spark, d, "pred_df").select("row_id", F.array(F.lit("train"), F.lit("valid")).alias("t"), F.array("best_train_r2_score", "best_valid_r2_score").alias("s"), "best_test_r2_score")
    return registry.multitask_perf(p, "row_id", "t", "s", "best_test_r2_score")


@R.query("SELECT row_id, coalesce(model_type, 'unknown') || ' model on ' || coalesce(features, 'unknown') || ' by ' || coalesce(splitter, 'unknown') || ' split' AS summary FROM pred_df")
def metadata_summary(spark, d):
    p = table(spark, d, "pred_df")
    return p.select("row_id", frames.describe_models(p, "%s model on %s by %s split", ["model_type", "features", "splitter"]).alias("summary"))


@R.query("SELECT dataset_key, list_sort(list(DISTINCT split_uuid)) AS models, count(DISTINCT split_uuid) AS n_models FROM split_registry GROUP BY 1")
def dataset_models(spark, d):
    return registry.dataset_models(table(spark, d, "split_registry"), "dataset_key", "split_uuid")


@R.query("WITH b AS (SELECT * FROM pred_df WHERE dataset_key IS NOT NULL AND model_type IS NOT NULL AND model_choice_score IS NOT NULL AND NOT isnan(model_choice_score) QUALIFY row_number() OVER (PARTITION BY dataset_key, model_type ORDER BY model_choice_score DESC, row_id) = 1) SELECT row_id, round(abs(best_test_r2_score - best_valid_r2_score), 6) AS abs_error FROM b")
def abs_error(spark, d):
    e = frames.best_model_errors(table(spark, d, "pred_df"), ["dataset_key", "model_type"], "model_choice_score", "row_id", "best_test_r2_score", "best_valid_r2_score")
    return e.select("row_id", r6(F.col("abs_error"), "abs_error"))


@R.query("SELECT DISTINCT lower(splitter) AS value FROM split_registry WHERE splitter IS NOT NULL")
def sorted_values(spark, d):
    from replicata.sources import catalog

    return catalog.values_for_key(catalog.as_catalog(table(spark, d, "split_registry"), ["reg_id"], ["splitter"]), "splitter")


@R.query("WITH r AS (SELECT rec_id, source, row_number() OVER (PARTITION BY source ORDER BY rec_id DESC) AS position, count(*) OVER (PARTITION BY source) AS n FROM htr3a_dtc_smiles_curated WHERE source IS NOT NULL) SELECT rec_id, source, position FROM r WHERE position <= round_even(n * 0.1e0, 0)")
def stratified_top_n(spark, d):
    h = table(spark, d, "htr3a_dtc_smiles_curated").select("rec_id", "source")
    return registry.stratified_top_n(h, "source", [F.col("rec_id").desc()], 0.1, "rec_id").select("rec_id", "source", "position")


@R.query("SELECT event_id, (value > e[1])::INT + (value > e[2])::INT + (value > e[3])::INT + (value > e[4])::INT AS bin FROM events, (SELECT quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS e FROM events)")
def quantile_bins(spark, d):
    return registry.quantile_bins(table(spark, d, "events"), "value", 5, "bin").select("event_id", "bin")


# Hyperparameters and features

_GRID = {"model_type": ["NN", "RF", "xgboost"], "featurizer": ["ecfp", "graphconv"], "lr": [0.01, 0.001], "trees": [100, 500]}


@R.query("SELECT * FROM (SELECT unnest(['NN', 'RF', 'xgboost']) AS model_type), (SELECT unnest(['ecfp', 'graphconv']) AS featurizer), (SELECT unnest([0.01e0, 0.001e0]) AS lr), (SELECT unnest([100, 500]) AS trees)")
def hpo_grid(spark, d):
    return registry.grid(spark, _GRID)


@R.query("SELECT i::INT AS i, round(0.1e0 + i * 0.225e0, 9) AS x FROM range(5) r(i)")
def hpo_linspace(spark, d):
    return spark.range(1).select(F.posexplode(registry.linspace(0.1, 1.0, 5)).alias("i", "x")).withColumn("x", F.round("x", 9))


@R.query("SELECT i::INT AS i, round(1e-4 * pow(1e3, i / 6.0e0), 9) AS x FROM range(7) r(i)")
def hpo_geomspace(spark, d):
    return spark.range(1).select(F.posexplode(registry.geomspace(1e-4, 1e-1, 7)).alias("i", "x")).withColumn("x", F.round("x", 9))


@R.query("WITH v AS (SELECT unnest([16, 32, 64, 128]) AS x) SELECT a.x || ',' || b.x AS layer_sizes FROM v a, v b WHERE a.x > b.x AND b.x <= 32 UNION ALL SELECT a.x || ',' || b.x || ',' || c.x FROM v a, v b, v c WHERE a.x > b.x AND b.x > c.x AND c.x <= 32")
def hpo_layers(spark, d):
    return registry.layer_combinations(spark, [16, 32, 64, 128], [2, 3], 32)


@R.query("SELECT dataset_key, model_type, features FROM (SELECT DISTINCT dataset_key FROM split_registry), (SELECT unnest(['NN', 'RF']) AS model_type), (SELECT unnest(['ecfp', 'rdkit_raw']) AS features)")
def hpo_jobs(spark, d):
    return frames.expand_shortlist(table(spark, d, "split_registry").select("dataset_key").distinct(), {"model_type": ["NN", "RF"], "features": ["ecfp", "rdkit_raw"]})


@R.query("SELECT DISTINCT s.dataset_key, t.model_type FROM split_registry s, (SELECT unnest(['NN', 'RF', 'GCNModel']) AS model_type, unnest([200, 300, 900]) AS params) t WHERE NOT EXISTS (SELECT 1 FROM pred_df p WHERE p.dataset_key = s.dataset_key AND p.model_type = t.model_type AND p.best_test_r2_score > 0.8) AND t.params * 2.0 < 1500")
def filter_jobs(spark, d):
    types = spark.createDataFrame([("NN", 200), ("RF", 300), ("GCNModel", 900)], "model_type string, params int")
    jobs = table(spark, d, "split_registry").select("dataset_key").distinct().crossJoin(F.broadcast(types)).withColumn("rows", F.lit(1500))
    return registry.filter_jobs(jobs, table(spark, d, "pred_df").filter("best_test_r2_score > 0.8"), ["dataset_key", "model_type"], "params", "rows", 2.0).select("dataset_key", "model_type")


_LONG = "l AS (SELECT (label >= 5)::INT AS y, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@R.query(f"WITH {_LONG} SELECT feature::INT AS feature, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM l GROUP BY 1")
def feature_stats(spark, d):
    s = registry.feature_stats(table(spark, d, "embeddings"), "embedding")
    return s.select("feature", "n", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"))


@R.query(f"WITH {_LONG}, g AS (SELECT feature, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, avg(x) FILTER (WHERE y = 1) AS m1, avg(x) FILTER (WHERE y = 0) AS m0, var_samp(x) FILTER (WHERE y = 1) AS v1, var_samp(x) FILTER (WHERE y = 0) AS v0 FROM l GROUP BY 1) SELECT feature::INT AS feature, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0e0 / n1 + 1.0e0 / n0)), 6) AS t FROM g")
def t_statistic(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))
    return registry.feature_stats(e, "embedding", "y").select("feature", r6(F.col("t"), "t"))


@R.query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0e0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0e0 AS b FROM lineitem) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def spearman(spark, d):
    return registry.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("n", r6(F.col("rho"), "rho"))


# Models


def _labelled(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") >= 5).cast("double").alias("y"), F.when(F.col("vec_id") % 10 < 8, "train").when(F.col("vec_id") % 10 == 8, "valid").otherwise("test").alias("subset"))


for _kind in ("RF", "GBT", "linear"):

    @R.query(name={"RF": "rf_train_predict", "GBT": "gbt_train_predict", "linear": "linear_train_predict"}[_kind])
    def _train(spark, d, kind=_kind):
        from replicata.operators import models

        return models.train_predict(_labelled(spark, d), kind, classification=True, seed=17)


@R.query()
def score_frame(spark, d):
    from replicata.operators import models

    data = _labelled(spark, d)
    m = models.fit(data.filter("subset = 'train'"), "RF", classification=False, seed=17)
    return models.predict(m, data.filter("subset <> 'train'"), "id")


@R.query()
def permutation_importance(spark, d):
    from replicata.operators import models

    data = _labelled(spark, d)
    m = models.fit(data.filter("subset = 'train'"), "linear", classification=False, seed=17)
    return models.permutation_importance(m, data.filter("subset <> 'train'"), "id", repeats=60, seed=17)


@R.query()
def network_predict(spark, d):
    """A network of one hidden layer learns the label of a vector; training stops by the validation rows."""
    from replicata.operators import networks

    rows = _labelled(spark, d)
    net, _, _ = networks.fit_network(rows, [16], "log", epochs=25, rate=0.02, seed=17)
    return networks.predict_network(net, rows, "id", "log")


@R.query()
def impurity_importance(spark, d):
    from replicata.operators import models

    m = models.fit(_labelled(spark, d).filter("subset = 'train'"), "RF", classification=True, seed=17)
    return models.impurity_importance(spark, m)


@R.query()
def rf_std(spark, d):
    from replicata.operators import models

    data = _labelled(spark, d)
    m = models.fit(data.filter("subset = 'train'"), "RF", classification=False, seed=17)
    return models.tree_std(m, data.filter("subset <> 'train'"), "id")


_RHO = """WITH l AS (SELECT vec_id AS r, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
k AS (SELECT r, i, rank() OVER (PARTITION BY i ORDER BY x) + (count(*) OVER (PARTITION BY i, x) - 1) / 2.0e0 AS k FROM l)
SELECT a.i::INT AS a, b.i::INT AS b, round(corr(a.k, b.k), 6) AS rho FROM k a JOIN k b USING (r) GROUP BY 1, 2"""


@R.query(_RHO)
def spearman_matrix(spark, d):
    m = registry.spearman_matrix(table(spark, d, "embeddings"), "embedding")
    return m.select("a", "b", r6(F.col("rho"), "rho"))


@R.query()
def feature_clusters(spark, d):
    return registry.feature_clusters(registry.spearman_matrix(table(spark, d, "embeddings"), "embedding"), 1.3)


@R.query()
def cluster_importance(spark, d):
    from replicata.operators import models

    data = _labelled(spark, d)
    m = models.fit(data.filter("subset = 'train'"), "linear", classification=False, seed=17)
    clusters = registry.feature_clusters(registry.spearman_matrix(table(spark, d, "embeddings"), "embedding"), 1.3)
    return models.cluster_importance(m, data.filter("subset <> 'train'"), "id", clusters, repeats=60, seed=17)


@R.query()
def bayes_search(spark, d):
    """Twelve trials of a linear model's penalty, scored by r2 of the validation rows."""
    from replicata.operators import metrics, models, tracking
    from replicata.plans.storage import materialize

    rows = materialize(_labelled(spark, d))

    def score(p):
        m = models.fit(rows.filter("subset = 'train'"), "linear", classification=False, regParam=p["penalty"], elasticNetParam=p["mix"])
        v = rows.filter("subset = 'valid'")
        return metrics.regression_metrics(models.predict(m, v, "id").join(v.select("id", "y"), "id"), "y", "pred", []).first().r2

    got = tracking.bayes_search({"penalty": ("loguniform", 1e-4, 1.0), "mix": ("choice", [0.0, 0.5, 1.0])}, score, 12, start=6, seed=17)
    return spark.createDataFrame([(i, float(g["params"]["penalty"]), g["params"]["mix"], g["loss"]) for i, g in enumerate(got)], "rank int, penalty double, mix double, loss double")


@R.query("SELECT model_uuid, best_test_r2_score FROM pred_df WHERE best_test_r2_score IS NOT NULL AND NOT isnan(best_test_r2_score) AND model_uuid IS NOT NULL ORDER BY best_test_r2_score DESC, model_uuid LIMIT 20")
def top_models(spark, d):
    from replicata.operators import tracking

    return tracking.top_models(table(spark, d, "pred_df").filter("model_uuid is not null").select("model_uuid", "best_test_r2_score"), "test_r2_score", 20)


@R.query("SELECT ampl_version, count(*) AS n, split_part(ampl_version, '.', 1) || '.' || split_part(ampl_version, '.', 2) IN ('1.5', '1.6') AS fits FROM pred_df WHERE ampl_version IS NOT NULL GROUP BY 1")
def compatible_versions(spark, d):
    from replicata.operators import tracking

    v = table(spark, d, "pred_df").filter("ampl_version is not null").groupBy("ampl_version").agg(F.count("*").alias("n"))
    return v.withColumn("fits", tracking.compatible(F.col("ampl_version"), [["1.5", "1.6"], ["1.4"]], "1.6.1"))


@R.query("SELECT format('compound_{:06d}', row_number() OVER (ORDER BY rec_id) - 1) AS gen_id, rec_id FROM htr3a_dtc_smiles_curated")
def generated_ids(spark, d):
    return curate.generated_ids(table(spark, d, "htr3a_dtc_smiles_curated").select("rec_id"), "rec_id", "gen_id")


@R.query("WITH c AS (SELECT source, relation, count(*) AS n FROM htr3a_dtc_smiles_curated WHERE relation IS NOT NULL GROUP BY 1, 2) SELECT source, relation AS mode, n AS mode_n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, relation) = 1")
def modes(spark, d):
    return curate.mode(table(spark, d, "htr3a_dtc_smiles_curated"), ["source"], "relation")


@R.query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def group_quantiles(spark, d):
    q = curate.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])
