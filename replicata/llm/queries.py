"""The pN_ queries of the problems tagged llm, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replicata.functions.keys import key_form, structure_form, subset_form
from replicata.llm import groups, leakage, overlap, packing, pii, topn
from replicata.sources.tables import table


# Problem 2


def _components(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "htr3a_dtc_smiles_curated").select(key_form(F.col("compound_id")).alias("node"), structure_form(F.col("base_rdkit_smiles")).alias("s"), "series_id")
    entity = lambda kind, x: F.when(x.isNotNull(), F.concat(F.lit(kind), F.md5(x)))
    records = c.select("node", F.explode(F.array(entity("s", F.col("s")), entity("r", F.col("series_id")))).alias("entity"))
    return groups.related(records)


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "split_table").select("row_id", "split_uuid", "fold", key_form(F.col("cmpd_id")).alias("node"), subset_form(F.col("subset")).alias("subset"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of related compounds torn apart by a split and fold."""
    return groups.torn_groups(_members(spark, d), _components(spark, d)).withColumnRenamed("component", "group_cmpd_id")


def p2_assigned(spark: SparkSession, d: str) -> DataFrame:
    """For every compound of every split and fold the subset that keeps its group together, in the shares of the registry.

    Of several registry rows of a split the latest counts (ties: the larger reg_id); without one, or with null shares, the subset is null.
    """
    m = _members(spark, d).filter("node is not null").select("split_uuid", "fold", "node").distinct()
    shares = table(spark, d, "split_registry").groupBy("split_uuid").agg(F.max(F.struct("created_at", "reg_id", "train_frac", "valid_frac")).alias("s"))
    named = m.join(_components(spark, d), "node", "left").withColumn("component", F.coalesce("component", "node"))
    s = groups.split_by_shares(F.col("component"), F.col("s.train_frac"), F.col("s.valid_frac"), F.col("split_uuid"), F.col("fold"))
    return named.join(shares, "split_uuid", "left").select("split_uuid", "fold", F.col("node").alias("cmpd_key"), F.col("component").alias("group_cmpd_id"), s.alias("subset"))


# Problem 3


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best models of every dataset and model type."""
    p = table(spark, d, "pred_df")
    once = topn.first_per_key(p, "model_uuid", "row_id", ["dataset_key", "model_type", "model_choice_score"])
    return topn.top_n_per_group(once, ["dataset_key", "model_type"], "model_choice_score", "row_id", 5).select("row_id")


# Problem 4


def _overlap_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, d, "htr3a_dtc_smiles_curated").select(key_form(F.col("compound_id")).alias("key"), structure_form(F.col("base_rdkit_smiles")).alias("text"))
    return _members(spark, d).withColumnRenamed("node", "key"), texts


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train row and a valid or test row with equal compounds or structures at most two edits apart."""
    return overlap.overlap_pairs(*_overlap_rows(spark, d))


def p4_containment(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs by role, with distance and the containment of the evaluation record in the training record."""
    return overlap.overlap_records(*_overlap_rows(spark, d))


def p4_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping evaluation rows, their pairs and how many of them training contains whole, per split, fold and record source of the evaluation compound.

    A compound counts once in each of its sources; ``source`` is null for compounds without records or without source.
    """
    found = overlap.overlap_records(*_overlap_rows(spark, d)).groupBy(F.col("eval_row").alias("row_id")).agg(F.count("*").alias("pairs"), F.max("containment").alias("containment"))
    per_row = _members(spark, d).join(found, "row_id")
    sources = table(spark, d, "htr3a_dtc_smiles_curated").select(key_form(F.col("compound_id")).alias("node"), "source").distinct()
    return per_row.join(sources, "node", "left").groupBy("split_uuid", "fold", "source").agg(F.count("*").alias("eval_rows"), F.sum("pairs").alias("pairs"), F.count_if(F.col("containment") == 1.0).alias("contained"))


# Problem 6


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.count_tokens(table(spark, d, "documents")), table(spark, d, "pack_targets"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every text in containers of each capacity."""
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers of each capacity are filled."""
    return packing.fill(_packed(spark, d), table(spark, d, "pack_targets"))


# Problem 7


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item, of all those that the operator finds with up to one edit."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("edits = 0").select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 12 consecutive words of an evaluation item with up to two words inserted, deleted or replaced, and with how many."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=2)


# Problem 8


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in the documents, once per distinct value of a document."""
    return pii.find_pii(table(spark, d, "documents"), table(spark, d, "name_lexicon"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The documents with placeholders of their kind for all personal data."""
    return pii.find_pii(table(spark, d, "documents"), table(spark, d, "name_lexicon"), redacted=True)


_KEY = "nullif(regexp_replace(lower({}), '[^a-z0-9]', '', 'g'), '')"
_SUBSET = r"CASE WHEN lower(regexp_replace(subset, '^\s+|\s+$', '', 'g')) IN ('train', 'valid', 'test') THEN lower(regexp_replace(subset, '^\s+|\s+$', '', 'g')) END"

_P3 = """
WITH once AS (SELECT * FROM pred_df QUALIFY model_uuid IS NULL OR row_number() OVER (PARTITION BY model_uuid ORDER BY row_id) = 1),
ok AS (SELECT row_id, dataset_key, model_type, CASE WHEN model_choice_score = 0 THEN 0.0 ELSE model_choice_score END AS s FROM once
  WHERE dataset_key IS NOT NULL AND model_type IS NOT NULL AND model_choice_score IS NOT NULL AND isfinite(model_choice_score))
SELECT row_id FROM ok QUALIFY row_number() OVER (PARTITION BY dataset_key, model_type ORDER BY s DESC, row_id) <= 5
"""

_STRUCTURE = r"""
compounds AS (SELECT DISTINCT KEYFORM AS k, series_id, string_split(regexp_replace(base_rdkit_smiles, '[\s@/\\]', '', 'g'), '.') AS pieces FROM htr3a_dtc_smiles_curated),
structures AS (SELECT DISTINCT k, series_id, nullif(list_filter(pieces, lambda x: length(x) = list_max(list_transform(pieces, lambda y: length(y))))[1], '') AS s FROM compounds WHERE k IS NOT NULL)
""".replace("KEYFORM", _KEY.format("compound_id"))

_MEMBERS = f"members AS (SELECT row_id, split_uuid, fold, {_KEY.format('cmpd_id')} AS k, {_SUBSET} AS subset FROM split_table)"

_P2 = f"""
WITH RECURSIVE {_STRUCTURE},
pairs AS (SELECT DISTINCT k, 's' || s AS e FROM structures WHERE s IS NOT NULL UNION SELECT DISTINCT k, 'r' || series_id FROM structures WHERE series_id IS NOT NULL),
stars AS (SELECT k, min(k) OVER (PARTITION BY e) AS m FROM pairs),
links AS (SELECT DISTINCT k AS a, m AS b FROM stars WHERE k <> m UNION SELECT DISTINCT m, k FROM stars WHERE k <> m),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS k, min(b) AS c FROM reach GROUP BY a),
{_MEMBERS}
SELECT split_uuid, fold, coalesce(c, m.k) AS group_cmpd_id FROM members m LEFT JOIN comp ON comp.k = m.k
WHERE m.k IS NOT NULL AND subset IS NOT NULL GROUP BY ALL HAVING count(DISTINCT subset) > 1
"""

_P2_ASSIGNED = _P2[: _P2.index("SELECT split_uuid, fold, coalesce(c, m.k)")].rstrip() + """,
reg AS (SELECT split_uuid, train_frac, valid_frac FROM split_registry QUALIFY row_number() OVER (PARTITION BY split_uuid ORDER BY created_at DESC NULLS LAST, reg_id DESC) = 1),
m AS (SELECT DISTINCT split_uuid, fold, members.k, coalesce(c, members.k) AS c FROM members LEFT JOIN comp ON comp.k = members.k WHERE members.k IS NOT NULL),
u AS (SELECT m.*, train_frac AS t, valid_frac AS v, ('0x' || substr(md5(concat_ws('|', c, m.split_uuid, fold)), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0e0 AS h FROM m LEFT JOIN reg ON reg.split_uuid = m.split_uuid)
SELECT split_uuid, fold, k AS cmpd_key, c AS group_cmpd_id, CASE WHEN h < t THEN 'train' WHEN h < t + v THEN 'valid' WHEN t + v IS NOT NULL THEN 'test' END AS subset FROM u
"""

_P4 = f"""
WITH {_STRUCTURE}, {_MEMBERS},
texts AS (SELECT DISTINCT k, s FROM structures WHERE s IS NOT NULL),
t AS (SELECT * FROM members WHERE subset = 'train' AND k IS NOT NULL),
e AS (SELECT * FROM members WHERE subset IN ('valid', 'test') AND k IS NOT NULL),
same AS (SELECT t.row_id AS a, e.row_id AS b FROM t JOIN e ON t.split_uuid = e.split_uuid AND t.fold = e.fold AND t.k = e.k),
near AS (SELECT t.row_id AS a, e.row_id AS b FROM t JOIN texts tt ON tt.k = t.k JOIN e ON t.split_uuid = e.split_uuid AND t.fold = e.fold
  JOIN texts te ON te.k = e.k WHERE abs(length(tt.s) - length(te.s)) <= 2 AND levenshtein(tt.s, te.s) <= 2)
SELECT DISTINCT least(a, b) AS row_id_a, greatest(a, b) AS row_id_b FROM (SELECT * FROM same UNION SELECT * FROM near)
"""
_P4_WITH = f"""
WITH {_STRUCTURE}, {_MEMBERS},
texts AS (SELECT DISTINCT k, s FROM structures WHERE s IS NOT NULL),
t AS (SELECT * FROM members WHERE subset = 'train' AND k IS NOT NULL),
e AS (SELECT * FROM members WHERE subset IN ('valid', 'test') AND k IS NOT NULL),
same AS (SELECT e.row_id AS eval_row, t.row_id AS train_row, true AS same_key, 0 AS distance, 1.0::DOUBLE AS containment FROM t JOIN e ON t.split_uuid = e.split_uuid AND t.fold = e.fold AND t.k = e.k),
near AS (SELECT e.row_id AS eval_row, t.row_id AS train_row, levenshtein(tt.s, te.s) AS distance, te.s AS es, tt.s AS ts FROM t JOIN texts tt ON tt.k = t.k JOIN e ON t.split_uuid = e.split_uuid AND t.fold = e.fold
  JOIN texts te ON te.k = e.k WHERE t.k <> e.k AND abs(length(tt.s) - length(te.s)) <= 2 AND levenshtein(tt.s, te.s) <= 2),
grams AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(es) - 1, 2)), lambda i: substring(es, i, 3))) AS ge, list_distinct(list_transform(range(1, greatest(length(ts) - 1, 2)), lambda i: substring(ts, i, 3))) AS gt FROM near),
records AS (SELECT * FROM same UNION ALL SELECT eval_row, train_row, false, distance, len(list_intersect(ge, gt)) / len(ge) FROM grams
  QUALIFY row_number() OVER (PARTITION BY eval_row, train_row ORDER BY distance, len(list_intersect(ge, gt)) / len(ge) DESC) = 1)
"""
_P4_CONTAINMENT = f"{_P4_WITH} SELECT * FROM records"
_P4_SOURCE = f"""{_P4_WITH}, per_row AS (SELECT eval_row AS row_id, count(*) AS pairs, max(containment) AS c FROM records GROUP BY 1),
sources AS (SELECT DISTINCT {_KEY.format("compound_id")} AS k, source FROM htr3a_dtc_smiles_curated)
SELECT split_uuid, fold, source, count(*) AS eval_rows, sum(pairs) AS pairs, count(*) FILTER (WHERE c = 1) AS contained
FROM members JOIN per_row USING (row_id) LEFT JOIN sources USING (k) GROUP BY ALL"""


_WORDS = r"""regexp_extract_all(lower(regexp_replace(regexp_replace(text, '[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{180E}]', '', 'g'),
 '([\p{L}\p{N}])[-\x{2010}\x{2011}][ \t]*(?:\r\n|[\r\n\x{0B}\x{0C}\x{85}\x{2028}\x{2029}])[ \t]*(?:>[ \t]*)*([\p{L}\p{N}])', '\1\2', 'g')), '[\p{L}\p{N}]+')"""
_P7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_assigned, p3_found, p4_found, p4_containment, p4_by_source, p6_packed, p6_fill, p7_found, p7_near, p8_found, p8_redacted)}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p2_assigned": _P2_ASSIGNED, "p3_found": _P3, "p7_found": _P7, "p4_found": _P4, "p4_containment": _P4_CONTAINMENT, "p4_by_source": _P4_SOURCE}
