"""The named queries as SQL for an independent engine, written from their definitions."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

SEED = 20260815
REPLICATES = 1000

V_SAMPLE = """
v_sample AS (
  SELECT *, 0.1::DOUBLE + 0.8::DOUBLE * raw AS calibrated, floor((1 - raw * 0.9::DOUBLE) * 100::DOUBLE) / 100::DOUBLE AS alt
  FROM (
    SELECT o_orderkey AS sample_id,
      CASE WHEN o_orderkey % 4 = 0 THEN 'B' ELSE 'A' END AS site_id,
      CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN '' ELSE concat(o_custkey, '_', o_orderkey % 8) END AS cluster_id,
      CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS task,
      CASE o_orderstatus WHEN 'O' THEN 'S' WHEN 'P' THEN 'I' ELSE 'R' END AS sir,
      CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS y,
      CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE o_orderkey END AS feature_row,
      floor(o_totalprice / 500::DOUBLE) / 1000::DOUBLE AS raw
    FROM orders)
)"""
V_DEV = "v_dev AS (SELECT * FROM v_sample WHERE d BETWEEN DATE '1995-01-01' AND DATE '1999-12-31')"
V_TEST = "v_test AS (SELECT * FROM v_sample WHERE d BETWEEN DATE '2000-02-01' AND DATE '2001-08-01')"
BASE = f"WITH {V_SAMPLE}, {V_DEV}, {V_TEST}"

WINDOWS = """
windows AS (
  SELECT * FROM (VALUES
    ('A_pre_marker_to_post_marker', 'development', DATE '1900-01-01', DATE '1997-12-31'),
    ('A_pre_marker_to_post_marker', 'test', DATE '1998-02-01', DATE '2001-08-01'),
    ('B_post_marker_current_temporal', 'development', DATE '1998-02-01', DATE '1999-12-31'),
    ('B_post_marker_current_temporal', 'test', DATE '2000-02-01', DATE '2001-08-01'),
    ('C_pooled_history_temporal', 'development', DATE '1900-01-01', DATE '2000-01-31'),
    ('C_pooled_history_temporal', 'test', DATE '2000-02-01', DATE '2001-08-01')) AS t(cohort, role, lo, hi)
), v_cohort AS (
  SELECT w.cohort, w.role, s.* FROM v_sample s JOIN windows w ON s.d BETWEEN w.lo AND w.hi
  WHERE NOT (w.cohort LIKE 'C_%' AND w.role = 'development' AND s.d BETWEEN DATE '1998-01-01' AND DATE '1998-01-31')
)"""


def usable(column: str) -> str:
    return f"({column} IS NOT NULL AND trim({column}) <> '')"


# --- label audit -------------------------------------------------------------------------------

_pairs = (
    ("ECONOMY", "Brand#1"), ("ECONOMY", "Brand#2"), ("LARGE", "Brand#3"), ("LARGE", "Brand#4"), ("MEDIUM", "Brand#5"),
    ("MEDIUM", "Brand#6"), ("PROMO", "Brand#7"), ("SMALL", "Brand#8"), ("STANDARD", "Brand#9"), ("STANDARD", "Brand#99"),
)
_core = " ".join(f"WHEN p_type = '{t}' AND p_brand = '{b}' THEN 'T{i:02d}'" for i, (t, b) in enumerate(_pairs))
_panel = ", ".join(
    f"('T{i:02d}', '{t}', '{b}', '{'literature_anchor' if i < 3 else 'local_extension'}', {i % 2 == 0})" for i, (t, b) in enumerate(_pairs)
)

V_AST = f"""
v_ast AS (
  SELECT CASE WHEN l_orderkey % 4 = 0 THEN 'B' ELSE 'A' END AS site_id, CAST(l_orderkey AS VARCHAR) AS sample_id,
    CAST(year(o_orderdate) AS INT) AS year,
    CASE WHEN l_orderkey % 101 = 0 THEN '' WHEN l_orderkey % 5 = 0 THEN '  ' || lower(p_type) || ' ' ELSE p_type END AS organism,
    p_brand AS drug_code, lower(p_brand) AS drug_name,
    CASE l_returnflag WHEN 'N' THEN 'S' WHEN 'A' THEN 'I' ELSE 'R' END AS sir_normalized,
    l_tax = 0.08::DOUBLE AS source_conflict, CASE {_core} ELSE '' END AS core_task_id,
    l_linenumber, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE year(o_orderdate) BETWEEN 1995 AND 2001
), v_scoped AS (
  SELECT *, lower(trim(organism)) AS organism_key, lower(trim(drug_code)) AS code_key, lower(trim(drug_name)) AS name_key,
    trim(organism) <> '' AS identity_complete,
    CASE WHEN trim(organism) <> '' THEN 'cmb_' || substr(sha256(lower(trim(organism)) || chr(31) || lower(trim(drug_code)) || chr(31) || lower(trim(drug_name))), 1, 16) ELSE '' END AS combination_id
  FROM v_ast
), v_groups AS (
  SELECT site_id, sample_id, combination_id, min(year) AS year, count(DISTINCT year) AS year_n, min(organism_key) AS organism_key,
    min(organism) AS organism, min(code_key) AS code_key, min(drug_code) AS drug_code, min(name_key) AS name_key, min(drug_name) AS drug_name,
    count(*) AS source_row_n, bool_or(source_conflict) AS source_conflict, count(DISTINCT sir_normalized) AS sir_n,
    min(sir_normalized) AS one_sir, coalesce(min(nullif(core_task_id, '')), '') AS core_task_ids
  FROM v_scoped WHERE identity_complete GROUP BY ALL
), v_collapsed AS (
  SELECT site_id, sample_id, combination_id, year, organism_key, organism, code_key, drug_code, name_key, drug_name, source_row_n,
    source_conflict, core_task_ids, (source_conflict OR sir_n > 1 OR year_n <> 1) AS conflict,
    CASE WHEN source_conflict OR sir_n > 1 OR year_n <> 1 THEN '' ELSE one_sir END AS resolved_sir,
    CASE WHEN source_conflict OR sir_n > 1 OR year_n <> 1 THEN NULL WHEN one_sir = 'S' THEN 0 ELSE 1 END AS y,
    CAST(sample_id AS BIGINT) % 17 <> 0 AS feature_available
  FROM v_groups
), v_inventory AS (
  SELECT combination_id, organism_key, code_key, name_key, organism_values, drug_code_values, drug_name_values, site_n, site_ids,
    raw_sample_combination_n, raw_unique_sample_n, conflict_n, conflict_free_sir_n, feature_linked_label_n, feature_linked_unique_sample_n,
    year_n, years, positive_n, negative_n, least(positive_n, negative_n) AS min_class_n, positive_n / nullif(feature_linked_label_n, 0) AS positive_rate,
    year_n >= 2 AS passes_min_years, feature_linked_label_n >= 300 AS passes_min_total, least(positive_n, negative_n) >= 50 AS passes_min_class,
    year_n >= 2 AND feature_linked_label_n >= 300 AND least(positive_n, negative_n) >= 50 AS support_eligible,
    concat_ws('|', CASE WHEN year_n < 2 THEN 'min_years' END, CASE WHEN feature_linked_label_n < 300 THEN 'min_total' END,
      CASE WHEN least(positive_n, negative_n) < 50 THEN 'min_class' END) AS support_exclusion_reasons, core_task_ids
  FROM (
    SELECT combination_id, min(organism_key) AS organism_key, min(code_key) AS code_key, min(name_key) AS name_key,
      array_to_string(list_transform(list_sort(list(DISTINCT {{'k': lower(trim(organism)), 'v': trim(organism)}})), lambda x: x.v), '|') AS organism_values,
      array_to_string(list_sort(list(DISTINCT trim(drug_code))), '|') AS drug_code_values,
      array_to_string(list_sort(list(DISTINCT trim(drug_name))), '|') AS drug_name_values,
      count(DISTINCT site_id) AS site_n, array_to_string(list_sort(list(DISTINCT site_id)), '|') AS site_ids,
      count(*) AS raw_sample_combination_n, count(DISTINCT sample_id) AS raw_unique_sample_n, count_if(conflict)::BIGINT AS conflict_n,
      count_if(NOT conflict)::BIGINT AS conflict_free_sir_n, count_if(NOT conflict AND feature_available)::BIGINT AS feature_linked_label_n,
      count(DISTINCT CASE WHEN NOT conflict AND feature_available THEN sample_id END) AS feature_linked_unique_sample_n,
      count(DISTINCT CASE WHEN NOT conflict AND feature_available THEN year END) AS year_n,
      coalesce(array_to_string(list_sort(list(DISTINCT year) FILTER (NOT conflict AND feature_available)), '|'), '') AS years,
      count_if(NOT conflict AND feature_available AND y = 1)::BIGINT AS positive_n,
      count_if(NOT conflict AND feature_available AND y = 0)::BIGINT AS negative_n,
      coalesce(array_to_string(list_sort(list(DISTINCT core_task_ids) FILTER (core_task_ids <> '')), '|'), '') AS core_task_ids
    FROM v_collapsed GROUP BY combination_id)
)"""

ORACLES["scope_normalized_labels"] = f"""WITH {V_AST}
SELECT site_id, sample_id, year, organism_key, code_key, name_key, identity_complete, combination_id, sir_normalized, source_conflict, core_task_id,
  CASE WHEN sir_normalized = 'S' THEN 0 ELSE 1 END AS y_s_vs_ir, CASE WHEN sir_normalized = 'R' THEN 1 ELSE 0 END AS y_si_vs_r
FROM v_scoped"""
ORACLES["collapsed_labels"] = f"WITH {V_AST} SELECT * FROM v_collapsed"
ORACLES["combination_inventory"] = f"WITH {V_AST} SELECT * REPLACE (round(positive_rate + 1.3e-9, 6) AS positive_rate) FROM v_inventory"
_STEPS = [
    (1, "scoped_linked_ast_rows", "Label rows of the chosen sites and years.", "NULL", ""),
    (2, "complete_exact_identity", "Rows that name an organism and a drug exactly.", "NULL", ""),
    (3, "unique_sample_combination", "Each sample and exact pair counted once.", "NULL", ""),
    (4, "conflict_free", "Pairs whose sources, categories and years agree.", "NULL", ""),
    (5, "binary_s_vs_ir_available", "Agreeing pairs with a category that has a binary value.", "NULL", ""),
    (6, "feature_linked", "Pairs whose sample has features.", "NULL", ""),
    (7, "minimum_year_support", "Combinations with enough years.", "2", "years"),
    (8, "minimum_total_support", "Of these, combinations with enough labels.", "300", "sample_combination_labels"),
    (9, "minimum_class_support", "Of these, combinations with enough labels of either class.", "50", "minimum_binary_class"),
]
_linked = "SELECT * FROM v_collapsed WHERE NOT conflict AND feature_available AND combination_id IN (SELECT combination_id FROM v_inventory WHERE {})"
_frames = [
    "SELECT sample_id, combination_id, CASE WHEN sir_normalized = 'S' THEN 0 ELSE 1 END AS y FROM v_scoped",
    "SELECT sample_id, combination_id, CASE WHEN sir_normalized = 'S' THEN 0 ELSE 1 END AS y FROM v_scoped WHERE identity_complete",
    "SELECT * FROM v_collapsed", "SELECT * FROM v_collapsed WHERE NOT conflict", "SELECT * FROM v_collapsed WHERE NOT conflict AND resolved_sir IN ('S', 'I', 'R')",
    "SELECT * FROM v_collapsed WHERE NOT conflict AND feature_available", _linked.format("passes_min_years"),
    _linked.format("passes_min_years AND passes_min_total"), _linked.format("support_eligible"),
]
ORACLES["support_funnel"] = f"WITH {V_AST} " + " UNION ALL ".join(
    f"""SELECT {k}::INT AS step_order, '{name}' AS step, '{text}' AS description, {limit}::INT AS threshold_value, '{unit}' AS threshold_unit,
    {'NULL::BIGINT' if k == 1 else 'count(DISTINCT combination_id)'} AS combination_n, count(*) AS label_rows, count(DISTINCT sample_id) AS unique_sample_n,
    coalesce(count_if(y = 1), 0)::BIGINT AS positive_n, coalesce(count_if(y = 0), 0)::BIGINT AS negative_n FROM ({frame})"""
    for (k, name, text, limit, unit), frame in zip(_STEPS, _frames, strict=True)
)
ORACLES["panel_mapping"] = f"""WITH {V_AST}, panel AS (SELECT * FROM (VALUES {_panel}) AS t(task_id, organism, antimicrobial, category, needed)),
members AS (
  SELECT task_id, count(*) AS n, array_to_string(list_sort(list(combination_id)), '|') AS ids, sum(feature_linked_label_n)::BIGINT AS linked,
    sum(positive_n)::BIGINT AS pos, sum(negative_n)::BIGINT AS neg, count_if(support_eligible)::BIGINT AS eligible
  FROM (SELECT unnest(string_split(core_task_ids, '|')) AS task_id, * FROM v_inventory) GROUP BY task_id)
SELECT p.task_id, organism, antimicrobial, category, coalesce(n, 0) AS exact_combination_n, coalesce(ids, '') AS exact_combination_ids,
  coalesce(linked, 0) AS feature_linked_label_n, coalesce(pos, 0) AS positive_n, coalesce(neg, 0) AS negative_n, coalesce(eligible, 0) AS eligible_combination_n,
  n IS NOT NULL AS observed, needed AS author_input_needed, CASE WHEN needed THEN 'no documented rationale' ELSE '' END AS author_input_reason
FROM panel p LEFT JOIN members m ON p.task_id = m.task_id"""
ORACLES["label_agreement"] = """WITH r AS (
  SELECT 'supp_' || (l_suppkey % 10) AS task_id, CASE l_returnflag WHEN 'N' THEN 'S' WHEN 'A' THEN 'I' ELSE 'R' END AS h,
    CASE WHEN l_orderkey % 13 = 0 THEN '' WHEN l_orderkey % 7 = 0 THEN 'R' WHEN l_returnflag = 'N' THEN 'S' WHEN l_returnflag = 'A' THEN 'I' ELSE 'R' END AS g,
    l_orderkey AS k FROM lineitem), q AS (
  SELECT *, CASE WHEN h = 'S' THEN 0 ELSE 1 END AS hy, CASE WHEN k % 11 = 0 THEN NULL WHEN g = 'S' THEN 0 ELSE 1 END AS gy, g <> '' AS i FROM r)
SELECT task_id, count(*) AS total_labels, count_if(i)::BIGINT AS interpreted_n,
  count_if(h = 'S')::BIGINT AS historical_s_n, count_if(h = 'I')::BIGINT AS historical_i_n, count_if(h = 'R')::BIGINT AS historical_r_n,
  count_if(i AND g = 'S')::BIGINT AS harmonized_s_n, count_if(i AND g = 'I')::BIGINT AS harmonized_i_n, count_if(i AND g = 'R')::BIGINT AS harmonized_r_n,
  count_if(i AND h <> g AND k % 17 <> 0)::BIGINT AS reclassified_n, count_if(NOT i)::BIGINT AS unsupported_n,
  round(count_if(i AND hy = gy) / count_if(i) + 1.3e-9, 6) AS binary_agreement, round(count_if(i AND h = g) / count_if(i) + 1.3e-9, 6) AS exact_agreement
FROM q GROUP BY task_id"""
ORACLES["alias_mapped"] = """SELECT p_partkey,
  CASE p_partkey % 9 WHEN 0 THEN 'cefepime' WHEN 1 THEN 'cefepime' WHEN 2 THEN '头孢吡肟' WHEN 3 THEN 'cefepime' WHEN 4 THEN 'ceftazidime'
    WHEN 5 THEN 'ceftazidime-avibactam' WHEN 6 THEN '头孢吡肟(马斯平)' WHEN 7 THEN 'gentamicin' ELSE '' END AS identity,
  CASE p_partkey % 9 WHEN 0 THEN 'cefepime' WHEN 1 THEN 'cefepime' WHEN 2 THEN 'cefepime' WHEN 3 THEN 'cefepime' WHEN 4 THEN 'ceftazidime'
    WHEN 6 THEN 'cefepime' WHEN 7 THEN 'gentamicin' ELSE '' END AS canonical
FROM part"""
ORACLES["feature_available"] = f"""{BASE}
SELECT sample_id, feature_row >= 0 AS by_feature_row, sample_id % 5 <> 0 AND sample_id % 3 = 0 AS by_flag, sample_id % 5 IN (0, 4) AS by_text,
  sample_id % 5 = 0 AS conflict_text, feature_row <> 0 AS conflict_number FROM v_sample"""
ORACLES["seeds"] = f"""SELECT c_custkey, {SEED} + CAST('0x' || substr(sha256('analysis|' || c_custkey || '|' || c_mktsegment), 1, 8) AS BIGINT) % 1000000 AS seed,
  'cmb_' || substr(sha256(c_mktsegment || chr(31) || c_name), 1, 16) AS combination FROM customer"""
ORACLES["canonical_parameters"] = """SELECT s_suppkey, concat('{"C":', s_nationkey, ',"max_iter":5000,"penalty":"l2"}') AS parameters, 'run_' || s_name AS run_id FROM supplier"""

# --- cohorts -----------------------------------------------------------------------------------

ORACLES["protocol_cohorts"] = f"{BASE}, {WINDOWS} SELECT cohort, role, task, sample_id, d, y FROM v_cohort"
ORACLES["regime_cohorts"] = f"""{BASE}
SELECT 'pre_marker_history_only' AS cohort, 'development' AS role, task, sample_id, d, y FROM v_sample WHERE d <= DATE '1997-12-31'
UNION ALL SELECT 'current_workflow_only', 'development', task, sample_id, d, y FROM v_sample WHERE d BETWEEN DATE '1998-02-01' AND DATE '1999-12-31'
UNION ALL SELECT 'pooled_pre_and_current', 'development', task, sample_id, d, y FROM v_sample WHERE d <= DATE '1997-12-31'
UNION ALL SELECT 'pooled_pre_and_current', 'development', task, sample_id, d, y FROM v_sample WHERE d BETWEEN DATE '1998-02-01' AND DATE '1999-12-31'
UNION ALL SELECT 'common_test', 'test', task, sample_id, d, y FROM v_sample WHERE d BETWEEN DATE '2000-02-01' AND DATE '2001-08-01'"""
ORACLES["date_window"] = f"""{BASE} SELECT sample_id, task, cluster_id, d AS target_date FROM v_sample WHERE d BETWEEN DATE '2000-02-01' AND DATE '2000-06-30'"""


def graded(n: str, p: str, q: str, total: int, minimum: int) -> tuple[str, str]:
    few, thin = f"{n} < {total}", f"least({p}, {q}) < {minimum}"
    status = f"CASE WHEN {n} = 0 OR least({p}, {q}) = 0 THEN 'insufficient' WHEN NOT ({few}) AND NOT ({thin}) THEN 'adequate' ELSE 'exploratory_or_insufficient' END"
    reason = (f"CASE WHEN {n} = 0 THEN 'no_samples' WHEN least({p}, {q}) = 0 THEN 'single_class' "
              f"ELSE concat_ws(';', CASE WHEN {few} THEN 'n<{total}' END, CASE WHEN {thin} THEN 'min_class<{minimum}' END) END")
    return status, reason


_status, _reason = graded("n_after", "positive_after_n", "negative_after_n", 100, 20)
_MODES = {
    "strict": (f"NOT {usable('t.cluster_id')}", f"{usable('t.cluster_id')} AND EXISTS (SELECT 1 FROM v_dev x WHERE x.task = t.task AND x.cluster_id = t.cluster_id)"),
    "annual": (f"NOT {usable('t.cluster_id')}", "EXISTS (SELECT 1 FROM v_dev x WHERE x.task = t.task AND x.cluster_id = coalesce(t.cluster_id, ''))"),
    "simple": ("t.cluster_id IS NULL", "EXISTS (SELECT 1 FROM v_dev x WHERE x.task = t.task AND x.cluster_id = t.cluster_id)"),
}
_marked = " UNION ALL ".join(f"SELECT '{m}' AS mode, t.task, t.y, {a} AS missing, {b} AS overlap FROM v_test t" for m, (a, b) in _MODES.items())
ORACLES["purge_audits"] = f"""{BASE}, marked AS ({_marked}), counted AS (
  SELECT task, mode, count(*) AS n_before, count_if(y = 1)::BIGINT AS positive_before_n, count_if(y = 0)::BIGINT AS negative_before_n,
    count_if(overlap)::BIGINT AS removed_overlap_n, count_if(missing)::BIGINT AS removed_missing_cluster_n, count_if(NOT overlap AND NOT missing)::BIGINT AS n_after,
    count_if(NOT overlap AND NOT missing AND y = 1)::BIGINT AS positive_after_n, count_if(NOT overlap AND NOT missing AND y = 0)::BIGINT AS negative_after_n
  FROM marked GROUP BY task, mode)
SELECT *, {_status} AS support_status, {_reason} AS insufficient_reason, CASE WHEN {_status} = 'adequate' THEN 'PASS' ELSE 'FAIL' END AS purge_status FROM counted"""
ORACLES["disjoint_test"] = f"""{BASE} SELECT sample_id, cluster_id, task, d, y FROM v_test t
WHERE {usable('cluster_id')} AND NOT EXISTS (SELECT 1 FROM v_dev x WHERE x.cluster_id = t.cluster_id)"""
ORACLES["first_per_cluster"] = f"""{BASE} SELECT cluster_id, sample_id, d, task, y FROM v_dev WHERE cluster_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY d, sample_id) = 1"""
ORACLES["latest_per_cluster"] = f"""{BASE} SELECT task, cluster_id, sample_id, d FROM v_sample WHERE {usable('cluster_id')}
QUALIFY row_number() OVER (PARTITION BY task, cluster_id ORDER BY d DESC, sample_id DESC) = 1"""


def month_folds(source: str, prefix: str) -> str:
    """CTEs <prefix>_audit and <prefix>_rows: monthly rolling-origin folds of a source table."""
    return f"""
{prefix}_m AS (SELECT task, date_trunc('month', d)::DATE AS m, row_number() OVER (PARTITION BY task ORDER BY date_trunc('month', d)) AS i, count(*) OVER (PARTITION BY task) AS n
  FROM (SELECT DISTINCT task, date_trunc('month', d) AS d FROM {source})),
{prefix}_b AS (SELECT DISTINCT task, b FROM (
    SELECT task, unnest([greatest(2, floor(n * 0.50::DOUBLE)::INT), greatest(2, floor(n * 0.67::DOUBLE)::INT), greatest(2, floor(n * 0.84::DOUBLE)::INT), n::INT]) AS b
    FROM (SELECT DISTINCT task, n FROM {prefix}_m WHERE n >= 4))),
{prefix}_f AS (SELECT task, b AS lo, lead(b) OVER (PARTITION BY task ORDER BY b) AS hi, row_number() OVER (PARTITION BY task ORDER BY b) - 1 AS fold_index FROM {prefix}_b),
{prefix}_all AS (
  SELECT s.*, f.fold_index, CASE WHEN m.i <= f.lo THEN 'train' ELSE 'validation' END AS split, m.m,
    'train_through=' || strftime(a.m, '%Y-%m') || ';validation=' || strftime(b.m, '%Y-%m') || '..' || strftime(c.m, '%Y-%m') AS fold_note
  FROM {source} s JOIN {prefix}_m m ON s.task = m.task AND date_trunc('month', s.d)::DATE = m.m JOIN {prefix}_f f ON f.task = s.task AND f.hi IS NOT NULL AND m.i <= f.hi
  JOIN {prefix}_m a ON a.task = s.task AND a.i = f.lo JOIN {prefix}_m b ON b.task = s.task AND b.i = f.lo + 1 JOIN {prefix}_m c ON c.task = s.task AND c.i = f.hi),
{prefix}_audit AS (
  SELECT *, n_train >= 50 AND n_validation >= 20 AND least(train_positive_n, train_negative_n) >= 10 AND least(validation_positive_n, validation_negative_n) >= 5 AS adequate FROM (
  SELECT task, fold_index AS border_index, fold_note, count_if(split = 'train')::BIGINT AS n_train, count_if(split = 'train' AND y = 1)::BIGINT AS train_positive_n,
    count_if(split = 'train' AND y = 0)::BIGINT AS train_negative_n, count_if(split <> 'train')::BIGINT AS n_validation,
    count_if(split <> 'train' AND y = 1)::BIGINT AS validation_positive_n, count_if(split <> 'train' AND y = 0)::BIGINT AS validation_negative_n
  FROM {prefix}_all GROUP BY task, fold_index, fold_note)),
{prefix}_rows AS (SELECT r.* FROM {prefix}_all r JOIN {prefix}_audit a ON r.task = a.task AND r.fold_index = a.border_index WHERE a.adequate)"""


ORACLES["month_folds"] = f"{BASE}, {month_folds('v_dev', 'mf')} SELECT * FROM mf_audit"
ORACLES["month_fold_rows"] = f"{BASE}, {month_folds('v_dev', 'mf')} SELECT task, fold_index, fold_note, split, sample_id, y FROM mf_rows"
ORACLES["first_per_cluster_protocol"] = f"""{BASE}, {month_folds('v_dev', 'mf')}, r AS (
  SELECT task, fold_index, split, sample_id, cluster_id, d, y FROM mf_rows
  UNION ALL SELECT task, -1, 'train', sample_id, cluster_id, d, y FROM v_dev UNION ALL SELECT task, -1, 'validation', sample_id, cluster_id, d, y FROM v_test),
tr AS (SELECT * FROM r WHERE split = 'train' AND cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, fold_index, cluster_id ORDER BY d, sample_id) = 1),
cand AS (SELECT * FROM r WHERE split = 'validation' AND cluster_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM tr WHERE tr.task = r.task AND tr.fold_index = r.fold_index AND tr.cluster_id = r.cluster_id)),
ev AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY task, fold_index, cluster_id ORDER BY d, sample_id) = 1),
c AS (SELECT task, fold_index, count_if(split = 'train')::BIGINT AS train_input_n, count_if(split = 'validation')::BIGINT AS evaluation_input_n FROM r GROUP BY ALL),
t AS (SELECT task, fold_index, count(*) AS train_n, count_if(y = 1)::BIGINT AS train_positive_n, count_if(y = 0)::BIGINT AS train_negative_n FROM tr GROUP BY ALL),
k AS (SELECT task, fold_index, count(*) AS cand_n FROM cand GROUP BY ALL),
e AS (SELECT task, fold_index, count(*) AS evaluation_n, count_if(y = 1)::BIGINT AS evaluation_positive_n, count_if(y = 0)::BIGINT AS evaluation_negative_n FROM ev GROUP BY ALL)
SELECT c.task, c.fold_index::INT AS fold_index, train_input_n, train_n, train_positive_n, train_negative_n, evaluation_input_n, evaluation_input_n - cand_n AS removed_seen_n,
  evaluation_n, evaluation_positive_n, evaluation_negative_n,
  CASE WHEN train_n >= 50 AND least(train_positive_n, train_negative_n) >= 10 AND evaluation_n >= 20 AND least(evaluation_positive_n, evaluation_negative_n) >= 5
    THEN 'adequate' ELSE 'insufficient' END AS status
FROM c JOIN t USING (task, fold_index) JOIN k USING (task, fold_index) JOIN e USING (task, fold_index)"""


def annual(n: str, p: str, q: str, total: int, minimum: int) -> tuple[str, str]:
    reason = (f"CASE WHEN {n} = 0 THEN 'no_split_rows' WHEN {n} < {total} THEN 'n<{total}' WHEN least({p}, {q}) = 0 THEN 'single_class' "
              f"WHEN least({p}, {q}) < {minimum} THEN 'min_class<{minimum}' ELSE '' END")
    status = f"CASE WHEN {n} = 0 THEN 'absent' WHEN {n} < {total} OR least({p}, {q}) < {minimum} THEN 'insufficient' ELSE 'adequate' END"
    return status, reason


_ts, _tr = annual("n_train", "train_positive_n", "train_negative_n", 20, 10)
_vs, _vr = annual("n_validation", "validation_positive_n", "validation_negative_n", 10, 5)
YEAR_FOLDS = f"""
yf_years AS (SELECT DISTINCT task, year AS vy FROM v_sample QUALIFY year > min(year) OVER (PARTITION BY task)),
yf_train AS (SELECT y.task, y.vy, min(s.year) AS lo, max(s.year) AS hi, count(*) AS n, count_if(s.y = 1)::BIGINT AS p, count_if(s.y = 0)::BIGINT AS q
  FROM yf_years y JOIN v_sample s ON s.task = y.task AND s.year < y.vy GROUP BY ALL),
yf_valid AS (SELECT s.*, NOT {usable('s.cluster_id')} AS missing,
    EXISTS (SELECT 1 FROM v_sample x WHERE x.task = s.task AND x.year < s.year AND x.cluster_id = coalesce(s.cluster_id, '')) AS overlap
  FROM v_sample s JOIN yf_years y ON s.task = y.task AND s.year = y.vy),
yf_count AS (SELECT task, year AS vy, count(*) AS n, count_if(overlap)::BIGINT AS o, count_if(missing)::BIGINT AS m, count_if(NOT overlap AND NOT missing)::BIGINT AS kn,
    count_if(NOT overlap AND NOT missing AND y = 1)::BIGINT AS kp, count_if(NOT overlap AND NOT missing AND y = 0)::BIGINT AS kq FROM yf_valid GROUP BY ALL),
yf_base AS (SELECT t.task, t.vy AS validation_year, t.lo AS train_year_min, t.hi AS train_year_max, t.n AS n_train, t.p AS train_positive_n, t.q AS train_negative_n,
    c.n AS n_validation_before_purge, c.o AS removed_overlap_n, c.m AS removed_missing_cluster_n, c.kn AS n_validation, c.kp AS validation_positive_n, c.kq AS validation_negative_n
  FROM yf_train t JOIN yf_count c ON t.task = c.task AND t.vy = c.vy),
yf_audit AS (SELECT *, CASE WHEN {_ts} = 'adequate' AND {_vs} = 'adequate' THEN 'adequate' ELSE 'insufficient' END AS status,
    concat_ws(';', nullif({_tr}, ''), nullif({_vr}, '')) AS insufficient_reason FROM yf_base)"""
ORACLES["year_folds"] = f"{BASE}, {YEAR_FOLDS} SELECT * FROM yf_audit"
ORACLES["year_fold_rows"] = f"""{BASE}, {YEAR_FOLDS}
SELECT s.task, a.validation_year::BIGINT AS fold_index, 'train' AS split, s.sample_id, s.y FROM v_sample s JOIN yf_audit a ON s.task = a.task AND s.year < a.validation_year WHERE a.status = 'adequate'
UNION ALL SELECT v.task, v.year, 'validation', v.sample_id, v.y FROM yf_valid v JOIN yf_audit a ON v.task = a.task AND v.year = a.validation_year
WHERE a.status = 'adequate' AND NOT v.missing AND NOT v.overlap"""
_hist = """SELECT '{regime}' AS regime, task, fold_index, sample_id, cluster_id, y, split FROM hf_rows"""
ORACLES["history_folds"] = f"""{BASE}, v_cur AS (SELECT * FROM v_sample WHERE d BETWEEN DATE '1998-02-01' AND DATE '1999-12-31'), v_pre AS (SELECT * FROM v_sample WHERE d < DATE '1998-01-01'),
{month_folds('v_cur', 'hf')}, r AS (
  {_hist.format(regime='current_workflow_only')} UNION ALL {_hist.format(regime='pooled_pre_and_current')}
  UNION ALL SELECT 'pooled_pre_and_current', p.task, f.fold_index, p.sample_id, p.cluster_id, p.y, 'train' FROM v_pre p JOIN (SELECT DISTINCT task, fold_index FROM hf_rows) f ON p.task = f.task),
k AS (SELECT *, NOT {usable('cluster_id')} AS missing, EXISTS (SELECT 1 FROM r x WHERE x.split = 'train' AND x.regime = r.regime AND x.task = r.task AND x.fold_index = r.fold_index
    AND x.cluster_id = coalesce(r.cluster_id, '')) AS overlap FROM r WHERE split = 'validation'),
t AS (SELECT regime, task, fold_index, count(*) AS n_train, count_if(y = 1)::BIGINT AS train_positive_n, count_if(y = 0)::BIGINT AS train_negative_n FROM r WHERE split = 'train' GROUP BY ALL),
v AS (SELECT regime, task, fold_index, count(*) AS n_validation_before_purge, count_if(overlap)::BIGINT AS removed_overlap_n, count_if(missing)::BIGINT AS removed_missing_cluster_n,
    count_if(NOT overlap AND NOT missing)::BIGINT AS n_validation, count_if(NOT overlap AND NOT missing AND y = 1)::BIGINT AS validation_positive_n,
    count_if(NOT overlap AND NOT missing AND y = 0)::BIGINT AS validation_negative_n FROM k GROUP BY ALL)
SELECT *, CASE WHEN n_train >= 20 AND least(train_positive_n, train_negative_n) >= 10 AND n_validation >= 10 AND least(validation_positive_n, validation_negative_n) >= 5
  THEN 'adequate' ELSE 'insufficient' END AS status FROM t JOIN v USING (regime, task, fold_index)"""
_gs, _gr = graded("n_rows", "positive_n", "negative_n", 100, 20)
_COUNTS = """count(*) AS n_rows, count(DISTINCT sample_id) AS unique_sample_n, count_if(y = 1)::BIGINT AS positive_n, count_if(y = 0)::BIGINT AS negative_n,
    count(DISTINCT CASE WHEN trim(cluster_id) <> '' THEN cluster_id END) AS cluster_n, count_if(cluster_id IS NULL OR trim(cluster_id) = '')::BIGINT AS missing_cluster_n"""
ORACLES["cohort_counts"] = f"""{BASE}, {WINDOWS}, c AS (SELECT cohort, role, task, site_id, {_COUNTS} FROM v_cohort GROUP BY ALL)
SELECT *, round(positive_n / n_rows + 1.3e-9, 6) AS positive_rate, {_gs} AS support_status, {_gr} AS insufficient_reason FROM c"""
_s1, _r1 = graded("n", "p", "q", 30, 8)
_s2, _r2 = annual("n", "p", "q", 30, 8)
_r3 = "CASE WHEN n = 0 THEN 'no_samples' WHEN least(p, q) = 0 THEN 'single_class' WHEN n < 30 THEN 'n<30' WHEN least(p, q) < 8 THEN 'min_class<8' ELSE '' END"
ORACLES["support_status"] = f"""{BASE}, g AS (SELECT task, sample_id % 97 AS cell, count_if(y = 1)::BIGINT AS p, count_if(y = 0)::BIGINT AS q FROM v_sample GROUP BY ALL),
h AS (SELECT *, p + q AS n FROM g)
SELECT *, {_s1} AS graded_status, {_r1} AS graded_reason, {_s2} AS annual_status, {_r2} AS annual_reason,
  CASE WHEN {_r3} = '' THEN 'adequate' ELSE 'insufficient' END AS contract_status, {_r3} AS contract_reason FROM h"""
ORACLES["row_ordinal"] = f"{BASE} SELECT task, sample_id, d, row_number() OVER (PARTITION BY task ORDER BY d, sample_id) - 1 AS row_order FROM v_sample"
ORACLES["group_attach"] = f"""{BASE}, g AS (SELECT sample_id, CASE WHEN sample_id % 2 = 1 THEN task WHEN sample_id % 3 = 0 THEN '' END AS gt, 'g' || (sample_id % 50) AS cluster_id,
  'e' || (sample_id % 20) AS episode_id FROM v_sample WHERE sample_id % 7 <> 0)
SELECT s.sample_id, s.task, s.y, g.cluster_id, g.episode_id FROM v_sample s LEFT JOIN g ON s.sample_id = g.sample_id AND (g.gt = s.task OR g.gt IS NULL OR trim(g.gt) = '')"""
ORACLES["episode_first_rows"] = f"{BASE} SELECT sample_id, cluster_id, task FROM v_sample WHERE cluster_id IS NOT NULL AND sample_id % 6 <> 0 AND sample_id % 4 = 1"
ERAS = f"""v_era AS (SELECT *, CASE WHEN d < DATE '1998-01-01' THEN 'pre' ELSE 'current' END AS era FROM v_sample WHERE {usable('cluster_id')}
  AND (d < DATE '1998-01-01' OR d BETWEEN DATE '1998-02-01' AND DATE '1999-12-31')),
v_caps AS (SELECT task, y AS class_label, count_if(era = 'pre')::BIGINT AS pre_available_n, count_if(era = 'current')::BIGINT AS current_available_n,
  least(count_if(era = 'pre'), count_if(era = 'current'))::BIGINT AS common_class_cap_n FROM v_era GROUP BY ALL)"""
ORACLES["class_caps"] = f"{BASE}, {ERAS} SELECT * FROM v_caps"


def size_matched(repeats: int) -> str:
    label = f"concat_ws('|', '{SEED}', task, repeat_index, era, y, sample_id)"
    return f"""ranked AS (SELECT e.*, repeat_index, row_number() OVER (PARTITION BY task, repeat_index, era, y ORDER BY md5({label}), {label}) - 1 AS rk
    FROM v_era e CROSS JOIN (SELECT unnest(range({repeats})) AS repeat_index)),
targets AS (SELECT task, class_label, fr, floor(common_class_cap_n * fr + 1e-12::DOUBLE)::BIGINT AS t FROM v_caps CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS fr)),
placed AS (SELECT r.task, r.repeat_index, t.fr AS learning_fraction, r.era, r.y, r.sample_id, r.rk, t.t,
    t.t // 2 + CASE WHEN t.t % 2 = 1 AND ((r.era = 'pre') = ((r.repeat_index + r.y) % 2 = 0)) THEN 1 ELSE 0 END AS half
  FROM ranked r JOIN targets t ON r.task = t.task AND r.y = t.class_label),
cells AS (SELECT *, 'current_workflow_only' AS training_regime FROM placed WHERE era = 'current' AND rk < t
  UNION ALL SELECT *, 'pre_marker_only' FROM placed WHERE era = 'pre' AND rk < t UNION ALL SELECT *, 'pooled_era_balanced' FROM placed WHERE rk < half)"""


ORACLES["size_matched_rows"] = f"{BASE}, {ERAS}, {size_matched(2)} SELECT task, repeat_index, learning_fraction, training_regime, era, y, sample_id FROM cells"
ORACLES["size_matched_cells"] = f"""{BASE}, {ERAS}, {size_matched(3)}, c AS (SELECT task, repeat_index, learning_fraction, training_regime, count(*) AS n_development,
  count_if(y = 0)::BIGINT AS development_negative_n, count_if(y = 1)::BIGINT AS development_positive_n, count_if(era = 'pre')::BIGINT AS pre_era_n,
  count_if(era = 'current')::BIGINT AS current_era_n, least(count_if(y = 0), count_if(y = 1))::BIGINT AS low FROM cells GROUP BY ALL)
SELECT * EXCLUDE (low), CASE WHEN low < 10 THEN 'insufficient' ELSE 'ok' END AS status,
  CASE WHEN low < 10 THEN 'fractional_min_class=' || low || '<minimum_train_class_n=10' ELSE '' END AS insufficient_reason FROM c"""

# --- features ----------------------------------------------------------------------------------

FEATURES = """
v_peaks AS (SELECT l_orderkey AS spectrum_id, l_orderkey // 10 AS sample_id, 2000::DOUBLE + l_extendedprice / 5.5::DOUBLE AS mz, l_quantity AS intensity FROM lineitem),
v_spectra AS (SELECT o_orderkey AS spectrum_id, o_orderkey // 10 AS sample_id FROM orders),
v_bins AS (SELECT spectrum_id, floor((mz - 2000::DOUBLE) / 3::DOUBLE)::INT AS bin, sqrt(max(intensity)) AS v FROM v_peaks WHERE mz >= 2000 AND mz < 20000 GROUP BY ALL),
v_feat AS (SELECT spectrum_id, bin, v / sqrt(sum(v * v) OVER (PARTITION BY spectrum_id)) AS value FROM v_bins),
v_mean AS (SELECT s.sample_id, f.bin, sum(f.value) / any_value(n.n) AS v FROM v_feat f JOIN v_spectra s USING (spectrum_id)
  JOIN (SELECT sample_id, count(*) AS n FROM v_spectra GROUP BY ALL) n ON n.sample_id = s.sample_id GROUP BY s.sample_id, f.bin),
v_samplefeat AS (SELECT sample_id, bin, v / sqrt(sum(v * v) OVER (PARTITION BY sample_id)) AS value FROM v_mean)"""
ORACLES["bin_spectrum"] = f"WITH {FEATURES} SELECT spectrum_id, bin, round(value + 1.3e-9, 6) AS value FROM v_feat"
ORACLES["replicate_mean"] = f"WITH {FEATURES} SELECT sample_id, bin, round(value + 1.3e-9, 6) AS value FROM v_samplefeat"
ORACLES["peak_presence"] = f"WITH {FEATURES} SELECT spectrum_id, bin FROM v_feat WHERE value > 0"
ORACLES["sample_presence"] = f"WITH {FEATURES} SELECT DISTINCT s.sample_id, f.bin FROM v_feat f JOIN v_spectra s USING (spectrum_id)"
ORACLES["replicate_statistics"] = f"""WITH {FEATURES}, c AS (SELECT o_orderkey // 10 AS sample_id, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY ALL)
SELECT count(*) AS sample_n, sum(n)::BIGINT AS spectrum_n, min(n) AS min_spectra, median(n)::DOUBLE AS median_spectra, max(n) AS max_spectra FROM c"""
ORACLES["presence_qc"] = f"""WITH {FEATURES}, o AS (
  SELECT DISTINCT 'above_' || c AS variant, spectrum_id, floor((mz - 2000::DOUBLE) / 3::DOUBLE)::INT AS bin FROM v_peaks CROSS JOIN (SELECT unnest([5, 25]) AS c) WHERE intensity > c AND mz >= 2000 AND mz < 20000),
r AS (SELECT 'above_' || c AS variant, spectrum_id FROM v_spectra CROSS JOIN (SELECT unnest([5, 25]) AS c)),
a AS (SELECT variant, spectrum_id, count(*) AS no FROM o GROUP BY ALL), b AS (SELECT spectrum_id, count(*) AS nf FROM v_feat GROUP BY ALL),
i AS (SELECT o.variant, o.spectrum_id, count(*) AS ni FROM o JOIN v_feat f ON o.spectrum_id = f.spectrum_id AND o.bin = f.bin GROUP BY ALL),
j AS (SELECT r.variant, coalesce(no, 0) AS no, coalesce(nf, 0) AS nf, coalesce(ni, 0) AS ni FROM r LEFT JOIN a USING (variant, spectrum_id) LEFT JOIN b USING (spectrum_id) LEFT JOIN i USING (variant, spectrum_id)),
k AS (SELECT *, CASE WHEN no + nf - ni = 0 THEN 1.0 ELSE ni / (no + nf - ni) END AS jac, ni = no AND ni = nf AS same FROM j)
SELECT variant, count(*) AS row_n, round(quantile_cont(no, 0.5) + 1.3e-9, 6)::DOUBLE AS detected_median, round(quantile_cont(no, 0.25) + 1.3e-9, 6)::DOUBLE AS detected_q25, round(quantile_cont(no, 0.75) + 1.3e-9, 6)::DOUBLE AS detected_q75,
  count_if(NOT same)::BIGINT AS rows_different_n, round(avg(same::INT) + 1.3e-9, 6) AS exact_match_rate, round(quantile_cont(jac::DOUBLE, 0.5) + 1.3e-9, 6) AS jaccard_median FROM k GROUP BY variant"""
ORACLES["feature_equivalence"] = f"""WITH {FEATURES}, x AS (SELECT sample_id, value AS a, (CASE WHEN sample_id % 50 = 3 THEN value + 0.001::DOUBLE ELSE value END)::FLOAT::DOUBLE AS b FROM v_samplefeat),
m AS (SELECT s.sample_id, coalesce(max(abs(a - b)), 0) AS diff, count(a) AS n FROM (SELECT DISTINCT sample_id FROM v_spectra) s LEFT JOIN x USING (sample_id) GROUP BY ALL)
SELECT count(*) AS row_n, count_if(diff <= 5e-7::DOUBLE)::BIGINT AS pass_n, count_if(diff > 5e-7::DOUBLE)::BIGINT AS fail_n, count_if(n = 0)::BIGINT AS zero_row_n, round(max(diff) + 1.3e-9, 6) AS max_abs_difference FROM m"""
ORACLES["matrix_scan"] = """SELECT l_linestatus, count(*) AS rows, count_if(l_orderkey % 900 = 0)::BIGINT AS nonfinite_n,
  (count_if(l_orderkey % 400 = 0) + count_if(l_orderkey % 900 = 0))::BIGINT AS nonbinary_n,
  CASE WHEN count_if(l_orderkey % 400 = 0) + count_if(l_orderkey % 900 = 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem GROUP BY l_linestatus"""

# --- evaluation --------------------------------------------------------------------------------


def totals(source: str, keys: str, score: str, prefix: str = "", weight: str = "1") -> str:
    """CTEs <prefix>leaf and <prefix>cum: counts per score and running totals from the highest score down."""
    return f"""
{prefix}leaf AS (SELECT {keys}, {score} AS s, sum(CASE WHEN y = 1 THEN {weight} ELSE 0 END)::BIGINT AS pos, sum(CASE WHEN y = 0 THEN {weight} ELSE 0 END)::BIGINT AS neg FROM {source} GROUP BY {keys}, {score}),
{prefix}cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {keys}) AS np, sum(neg) OVER (PARTITION BY {keys}) AS nn
  FROM {prefix}leaf WINDOW w AS (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


EDGES = ", ".join(repr(i / 10) if i not in (3, 6, 7) else {3: "0.30000000000000004", 6: "0.6000000000000001", 7: "0.7000000000000001"}[i] for i in range(1, 10))
BIN10 = f"len(list_filter([{EDGES}]::DOUBLE[], lambda e: s >= e))"


def metrics(keys: str, prefix: str = "") -> str:
    """CTE <prefix>met with all score metrics from <prefix>cum."""
    return f"""
{prefix}rank AS (SELECT {keys}, max(np)::BIGINT AS positive_n, max(nn)::BIGINT AS negative_n,
    CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(pos * (nn - fp + neg / 2)) / (max(np)::DOUBLE * max(nn)) END AS auroc,
    CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(CASE WHEN pos > 0 THEN pos / np * (tp / (tp + fp)) ELSE 0 END) END AS auprc,
    max(np) / (max(np) + max(nn)) AS auprc_baseline,
    sum(pos * (1 - s) * (1 - s) + neg * s * s) / sum(pos + neg) AS brier
  FROM {prefix}cum GROUP BY {keys}),
{prefix}ecebin AS (SELECT {keys}, {BIN10} AS b, sum(pos) AS p, sum((pos + neg) * s) AS q, sum(pos + neg) AS n FROM {prefix}cum GROUP BY {keys}, b),
{prefix}ece AS (SELECT {keys}, sum(abs(p - q)) / sum(n) AS ece FROM {prefix}ecebin GROUP BY {keys}),
{prefix}met AS (SELECT *, auprc / auprc_baseline AS auprc_lift FROM {prefix}rank JOIN {prefix}ece USING ({keys}))"""


def rnd(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c.strip()} + 1.3e-9, {digits}) AS {c.strip()}" for c in columns.split(","))


ORACLES["auroc_auprc"] = f"""{BASE}, {totals('v_sample', 'task, site_id', 'raw')}, {metrics('task, site_id')}
SELECT task, site_id, positive_n, negative_n, {rnd('auroc, auprc, auprc_baseline, auprc_lift')} FROM met"""
ORACLES["brier_ece"] = f"""{BASE}, {totals('v_sample', 'task, site_id', 'calibrated')}, {metrics('task, site_id')} SELECT task, site_id, {rnd('brier, ece')} FROM met"""


def right_edges(bins: int) -> str:
    special = {3: "0.30000000000000004", 6: "0.6000000000000001", 7: "0.7000000000000001"}
    if bins == 10:
        return "[" + ", ".join(special.get(i, repr(i / 10)) for i in range(1, 10)) + "]::DOUBLE[]"
    return "[0.2, 0.4, 0.6000000000000001, 0.8]::DOUBLE[]"


def quantile_edges(bins: int) -> str:
    points = {5: "[0.2, 0.4, 0.6000000000000001, 0.8]", 10: right_edges(10).removesuffix("::DOUBLE[]")}[bins]
    return f"quantile_cont(raw, {points}::DOUBLE[])"


ORACLES["ece_sensitivity"] = f"""{BASE}, edges AS (
  SELECT task, site_id, 5 AS bin_n, 'equal_width' AS strategy, {right_edges(5)} AS e FROM v_sample GROUP BY ALL
  UNION ALL SELECT task, site_id, 10, 'equal_width', {right_edges(10)} FROM v_sample GROUP BY ALL
  UNION ALL SELECT task, site_id, 5, 'equal_frequency', list_filter(list_distinct({quantile_edges(5)}), lambda x: x > 0 AND x < 1) FROM v_sample GROUP BY task, site_id
  UNION ALL SELECT task, site_id, 10, 'equal_frequency', list_filter(list_distinct({quantile_edges(10)}), lambda x: x > 0 AND x < 1) FROM v_sample GROUP BY task, site_id),
b AS (SELECT task, site_id, bin_n, strategy, len(list_filter(e, lambda x: s.raw > x)) AS bin, count(*) AS n, sum(y) AS p, sum(raw) AS q FROM v_sample s JOIN edges USING (task, site_id) GROUP BY ALL)
SELECT task, site_id, bin_n::BIGINT AS bin_n, strategy, sum(n)::BIGINT AS n, sum(p)::BIGINT AS positive_n, sum(n - p)::BIGINT AS negative_n, round(sum(abs(p - q)) / sum(n) + 1.3e-9, 6) AS ece FROM b GROUP BY ALL"""


def points(source: str, keys: str, score: str) -> str:
    """CTE pts: operating points at 0, every score, 1 and just above 1, by definition."""
    return f"""
thr AS (SELECT DISTINCT {keys}, {score} AS threshold FROM {source} UNION SELECT {keys}, unnest([0.0, 1.0, 1.0000000000000002]::DOUBLE[]) FROM {source}),
cnt AS (SELECT {keys}, {score} AS s, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM {source} GROUP BY ALL),
tot AS (SELECT {keys}, sum(pos) AS np, sum(neg) AS nn FROM cnt GROUP BY ALL),
ptc AS (SELECT {', '.join('t.' + k.strip() for k in keys.split(','))}, t.threshold, coalesce(sum(c.pos), 0)::BIGINT AS tp, coalesce(sum(c.neg), 0)::BIGINT AS fp
  FROM thr t LEFT JOIN cnt c ON {' AND '.join(f't.{k.strip()} = c.{k.strip()}' for k in keys.split(','))} AND c.s >= t.threshold GROUP BY ALL),
pts AS (SELECT ptc.*, tp / np AS sensitivity, (nn - fp) / nn AS specificity FROM ptc JOIN tot USING ({keys}) WHERE np > 0 AND nn > 0)"""


ORACLES["operating_points"] = f"{BASE}, {points('v_sample', 'task', 'raw')} SELECT task, threshold, tp, fp, {rnd('sensitivity, specificity')} FROM pts"
_POLICY_M = """max_by(threshold, {'j': sensitivity + specificity - 1.0, 't': threshold}) AS youden, max(threshold) FILTER (sensitivity >= 0.9::DOUBLE) AS sensitivity90,
  min(threshold) FILTER (specificity >= 0.9::DOUBLE) AS specificity90"""
ORACLES["thresholds_m"] = f"{BASE}, {points('v_sample', 'task, site_id', 'raw')} SELECT task, site_id, {_POLICY_M} FROM pts GROUP BY ALL"
ORACLES["thresholds_r"] = f"""{BASE}, {totals('v_sample', 'task, site_id', 'alt')},
v AS (SELECT *, lag(tp) OVER w AS tp0, lead(tp) OVER w AS tp2, lag(fp) OVER w AS fp0, lead(fp) OVER w AS fp2 FROM cum WINDOW w AS (PARTITION BY task, site_id ORDER BY s DESC)),
k AS (SELECT task, site_id, s, tp / np AS tpr, fp / nn AS fpr FROM v WHERE tp0 IS NULL OR tp2 IS NULL OR tp2 - 2 * tp + tp0 <> 0 OR fp2 - 2 * fp + fp0 <> 0)
SELECT task, site_id, round(max_by(s, {{'v': tpr - fpr, 's': s}}), 9) AS youden,
  round(coalesce(max_by(s, {{'v': 1.0 - fpr, 's': s}}) FILTER (tpr >= 0.9::DOUBLE), min(s) - 1e-9), 9) AS sens90,
  round(coalesce(max_by(s, {{'v': tpr, 's': s}}) FILTER (1.0 - fpr >= 0.9::DOUBLE), max(s) + 1e-9), 9) AS spec90 FROM k GROUP BY ALL"""
SOURCE_T = f"""v_src AS (SELECT * FROM v_dev WHERE site_id = 'A'), {points('v_src', 'task', 'calibrated')},
wide AS (SELECT task, {_POLICY_M} FROM pts GROUP BY ALL),
cut AS (UNPIVOT wide ON youden, sensitivity90, specificity90 INTO NAME threshold_name VALUE threshold),
cells AS (SELECT t.task, threshold_name, threshold, count_if(calibrated >= threshold AND y = 1)::BIGINT AS tp, count_if(calibrated < threshold AND y = 0)::BIGINT AS tn,
  count_if(calibrated >= threshold AND y = 0)::BIGINT AS fp, count_if(calibrated < threshold AND y = 1)::BIGINT AS fn FROM v_test t JOIN cut c ON t.task = c.task GROUP BY ALL),
rates AS (SELECT *, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity, tp / nullif(tp + fp, 0) AS ppv, tn / nullif(tn + fn, 0) AS npv,
  1 - tp / nullif(tp + fn, 0) AS false_susceptible_rate, 1 - tn / nullif(tn + fp, 0) AS false_resistant_rate FROM cells)"""
_RATES = "sensitivity, specificity, ppv, npv, false_susceptible_rate, false_resistant_rate"
ORACLES["confusion_rates"] = f"{BASE}, {SOURCE_T} SELECT task, threshold_name, tp, tn, fp, fn, {rnd('threshold, ' + _RATES)} FROM rates"
_flat = ", ".join(
    f"round(max(CASE WHEN threshold_name = '{n}' THEN {f} END) + 1.3e-9, 6) AS {f}_{n}"
    for n in ("youden", "sensitivity90", "specificity90") for f in ("threshold", *[r.strip() for r in _RATES.split(",")])
)
ORACLES["metric_bundle"] = f"""{BASE}, {SOURCE_T}, flat AS (SELECT task, {_flat} FROM rates GROUP BY task),
{totals('v_test', 'task', 'raw', 'r_')}, {metrics('task', 'r_')}, {totals('v_test', 'task', 'calibrated', 'c_')}, {metrics('task', 'c_')}
SELECT r.task, r.positive_n, r.negative_n, round(r.auprc_baseline + 1.3e-9, 6) AS auprc_baseline,
  {', '.join(f'round({p[0]}.{m} + 1.3e-9, 6) AS {p}_{m}' for p in ('raw', 'calibrated') for m in ('auroc', 'auprc', 'auprc_lift', 'brier', 'ece'))},
  flat.* EXCLUDE (task), true AS threshold_metrics_valid
FROM r_met r JOIN c_met c ON r.task = c.task JOIN flat ON flat.task = r.task"""
ORACLES["guarded_rows"] = f"""{BASE}, cell AS (SELECT *, CASE WHEN sample_id % 40 = 0 THEN 'small' ELSE 'large' END AS cell FROM v_test),
{totals('cell', 'task, cell', 'raw')}, {metrics('task, cell')}, c AS (SELECT task, cell, {_COUNTS} FROM cell GROUP BY ALL),
g AS (SELECT *, round(positive_n / n_rows + 1.3e-9, 6) AS positive_rate, {_gs} AS support_status, {_gr} AS insufficient_reason FROM c)
SELECT g.*, {', '.join(f"CASE WHEN support_status = 'adequate' THEN round(m.{c} + 1.3e-9, 6) END AS {c}" for c in ('auroc', 'auprc', 'auprc_baseline', 'auprc_lift', 'brier', 'ece'))},
  CASE WHEN support_status = 'adequate' THEN 'ok' ELSE support_status END AS status FROM g LEFT JOIN met m ON g.task = m.task AND g.cell = m.cell"""


def resample(source: str, draw: str, keys: str, scores: list[str], cluster_source: str | None = None) -> str:
    """CTEs: cluster slots in hash order, draws by digest pieces, weights, weighted score rows 'rows'."""
    unit = "CASE WHEN cluster_id IS NOT NULL AND trim(cluster_id) <> '' THEN cluster_id ELSE 'sample:' || sample_id END"
    label = f"concat_ws('|', '{SEED}', {draw}, slot)"
    coef = ", ".join(f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) % 2147483647 AS c{i}" for i in range(8))

    def poly(i: int) -> str:
        inner = f"((c{i} * replicate + c{i + 1}) % 2147483647 * replicate + c{i + 2}) % 2147483647"
        return f"(({inner} * replicate + c{i + 3}) % 2147483647)"

    stacked = " UNION ALL ".join(f"SELECT {keys}, y, u, '{s}' AS kind, {s} AS score FROM unit" for s in scores)
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in draw.split(","))
    qualified = ", ".join("a." + k.strip() for k in keys.split(","))
    return f"""
unit AS (SELECT *, {unit} AS u FROM {source}),
slots AS (SELECT {draw}, u, row_number() OVER (PARTITION BY {draw} ORDER BY md5(u), u) - 1 AS slot, count(*) OVER (PARTITION BY {draw}) AS g FROM (SELECT DISTINCT {draw}, u FROM unit)),
coef AS (SELECT *, {coef} FROM (SELECT *, sha256({label}) AS h FROM slots)),
drawn AS (SELECT {draw}, replicate, ({poly(0)} * 2147483647 + {poly(4)}) % g AS slot FROM coef CROSS JOIN (SELECT unnest(range({REPLICATES})) AS replicate)),
weights AS (SELECT {draw}, replicate, slot, count(*) AS w FROM drawn GROUP BY ALL),
stacked AS ({stacked}),
boot AS (SELECT {qualified}, a.kind, a.score, a.y, w.replicate, w.w FROM stacked a JOIN slots b ON {on} AND a.u = b.u
  JOIN weights w ON {on.replace('a.', 'w.')} AND w.slot = b.slot)"""


_QI = "count(v) AS bootstrap_valid_n, round(quantile_cont(v, 0.025) + 1.3e-9, 6) AS ci_low, round(quantile_cont(v, 0.975) + 1.3e-9, 6) AS ci_high, round(quantile_cont(v, 0.5) + 1.3e-9, 6) AS bootstrap_median"
_QI = f"{REPLICATES}::BIGINT AS bootstrap_requested_n, {_QI}"
ORACLES["bootstrap_ci"] = f"""{BASE}, {resample('v_sample', 'task', 'task', ['raw', 'alt'])}, {totals('boot', 'task, kind, replicate', 'score', '', 'w')}, {metrics('task, kind, replicate')},
l AS (UNPIVOT (SELECT * FROM met WHERE auroc IS NOT NULL) ON auroc, auprc, auprc_lift, brier, ece INTO NAME metric VALUE v)
SELECT task, kind, metric, {_QI} FROM l GROUP BY ALL"""
ORACLES["site_delta"] = f"""{BASE}, {resample('v_sample', 'task, site_id', 'task, site_id', ['raw'])}, {totals('boot', 'task, site_id, kind, replicate', 'score', '', 'w')}, {metrics('task, site_id, kind, replicate')},
{totals('v_sample', 'task, site_id', 'raw', 'o_')}, {metrics('task, site_id', 'o_')},
l AS (UNPIVOT (SELECT task, site_id, kind, replicate, auroc, auprc FROM met) ON auroc, auprc INTO NAME metric VALUE v),
ol AS (UNPIVOT (SELECT task, site_id, auroc, auprc FROM o_met) ON auroc, auprc INTO NAME metric VALUE v),
dl AS (SELECT a.task, a.kind, a.metric, a.replicate, b.v - a.v AS v FROM l a JOIN l b ON a.task = b.task AND a.kind = b.kind AND a.metric = b.metric AND a.replicate = b.replicate AND a.site_id = 'A' AND b.site_id = 'B'),
ci AS (SELECT task, kind, metric, {_QI} FROM dl GROUP BY ALL),
ob AS (SELECT a.task, a.metric, round(a.v + 1.3e-9, 6) AS source_estimate, round(b.v + 1.3e-9, 6) AS target_estimate, round(b.v - a.v + 1.3e-9, 6) AS delta_target_minus_source
  FROM ol a JOIN ol b ON a.task = b.task AND a.metric = b.metric AND a.site_id = 'A' AND b.site_id = 'B')
SELECT * FROM ci JOIN ob USING (task, metric)"""
ORACLES["paired_delta"] = f"""{BASE}, al AS (SELECT task, sample_id, cluster_id, y, raw AS "current", alt AS pre, calibrated * alt AS pooled FROM v_test WHERE {usable('cluster_id')}),
{resample('al', 'task', 'task', ['"current"', 'pre', 'pooled']).replace("'\"current\"'", "'current'")}, {totals('boot', 'task, kind, replicate', 'score', '', 'w')}, {metrics('task, kind, replicate')},
{totals('stacked', 'task, kind', 'score', 'o_')}, {metrics('task, kind', 'o_')},
l AS (UNPIVOT (SELECT task, kind, replicate, auroc, auprc FROM met) ON auroc, auprc INTO NAME metric VALUE v),
ol AS (UNPIVOT (SELECT task, kind, auroc, auprc FROM o_met) ON auroc, auprc INTO NAME metric VALUE v),
dl AS (SELECT a.task, a.kind AS comparator, a.metric, a.v - b.v AS v FROM l a JOIN l b ON a.task = b.task AND a.metric = b.metric AND a.replicate = b.replicate AND b.kind = 'current' AND a.kind <> 'current'),
ob AS (SELECT a.task, a.kind AS comparator, a.metric, 'current' AS reference, round(a.v - b.v + 1.3e-9, 6) AS delta_comparator_minus_reference FROM ol a JOIN ol b ON a.task = b.task AND a.metric = b.metric AND b.kind = 'current' AND a.kind <> 'current'),
ci AS (SELECT task, comparator, metric, {_QI} FROM dl GROUP BY ALL)
SELECT * FROM ob JOIN ci USING (task, comparator, metric)"""
ORACLES["median_transport"] = f"""{BASE}, {resample('v_sample', 'site_id', 'site_id, task', ['raw'])}, {totals('boot', 'site_id, task, replicate', 'score', '', 'w')}, {metrics('site_id, task, replicate')},
{totals('v_sample', 'site_id, task', 'raw', 'o_')}, {metrics('site_id, task', 'o_')},
dr AS (SELECT replicate, median(auroc) FILTER (site_id = 'A') AS source_median, median(auroc) FILTER (site_id = 'B') AS target_median FROM met GROUP BY replicate HAVING count(auroc) = 10),
ob AS (SELECT median(auroc) FILTER (site_id = 'A') AS source_median, median(auroc) FILTER (site_id = 'B') AS target_median FROM o_met),
l AS (UNPIVOT (SELECT *, target_median - source_median AS delta FROM dr) ON source_median, target_median, delta INTO NAME quantity VALUE v),
ol AS (UNPIVOT (SELECT *, target_median - source_median AS delta FROM ob) ON source_median, target_median, delta INTO NAME quantity VALUE estimate),
ci AS (SELECT quantity, {_QI} FROM l GROUP BY ALL)
SELECT ci.*, round(estimate + 1.3e-9, 6) AS estimate FROM ci JOIN ol USING (quantity)"""
ORACLES["precision_flags"] = f"""{BASE}, cell AS (SELECT *, strftime(d, '%Y-%m') AS cell FROM v_sample), {totals('cell', 'task, cell', 'raw')}, {metrics('task, cell')},
h AS (SELECT task, cell, positive_n + negative_n AS n_test, positive_n, negative_n, auroc, 1 / sqrt(least(positive_n, negative_n)) AS half FROM met WHERE auroc IS NOT NULL),
k AS (SELECT task, cell, n_test, positive_n, negative_n, auroc AS raw_auroc, auroc - half AS raw_auroc_ci_low, auroc + half AS raw_auroc_ci_high FROM h),
f AS (SELECT *, raw_auroc_ci_high - raw_auroc_ci_low AS raw_auroc_ci_width, n_test >= 100 AND least(positive_n, negative_n) >= 20 AS minimum_support_met FROM k)
SELECT task, cell, n_test, positive_n, negative_n, {rnd('raw_auroc, raw_auroc_ci_low, raw_auroc_ci_high, raw_auroc_ci_width')}, minimum_support_met,
  CASE WHEN minimum_support_met THEN 'prespecified_support_adequate' ELSE 'insufficient_support' END AS support_classification,
  CASE WHEN NOT minimum_support_met THEN 'insufficient_class_support' WHEN raw_auroc_ci_width > 0.2::DOUBLE THEN 'wide_95pct_interval_over_0.20' ELSE 'interval_width_at_or_below_0.20' END AS precision_flag FROM f"""

# --- selection, comparisons --------------------------------------------------------------------

ORACLES["tuning_selection"] = f"""{BASE}, c AS (SELECT task, year AS fold_index, y, unnest([0, 1, 2, 3]) AS candidate_index, unnest([raw, alt, calibrated, raw * alt]) AS score FROM v_sample),
{totals('c', 'task, candidate_index, fold_index', 'score')}, {metrics('task, candidate_index, fold_index')},
s AS (SELECT task, candidate_index, count(DISTINCT fold_index) AS folds, median(auroc) AS median_auroc, median(auprc) AS median_auprc FROM met GROUP BY ALL),
b AS (SELECT *, median_auroc + 0.05::DOUBLE * median_auprc AS objective FROM s QUALIFY row_number() OVER (PARTITION BY task ORDER BY round(median_auroc + 0.05::DOUBLE * median_auprc, 12) DESC, round(median_auroc, 12) DESC, round(median_auprc, 12) DESC, candidate_index) = 1)
SELECT task, candidate_index::BIGINT AS candidate_index, folds, {rnd('median_auroc, median_auprc, objective')} FROM b"""
_REG = ("current_workflow_only", "pre_marker_only", "pooled_era_balanced")
_CMP = ((_REG[2], _REG[0]), (_REG[1], _REG[0]), (_REG[2], _REG[1]))
_delta = " UNION ALL ".join(
    f"SELECT a.task, a.repeat_index, '{x}_minus_{z}' AS comparison_id, '{x}' AS comparator_regime, '{z}' AS reference_regime, '{m}' AS metric, a.{c} - b.{c} AS v "
    f"FROM met a JOIN met b ON a.task = b.task AND a.repeat_index = b.repeat_index WHERE a.regime = '{x}' AND b.regime = '{z}'"
    for x, z in _CMP for m, c in (("raw_auroc", "auroc"), ("raw_auprc", "auprc"))
)
ORACLES["delta_summary"] = f"""{BASE}, p AS (SELECT task, sample_id, y, alt, unnest(['{_REG[0]}', '{_REG[1]}', '{_REG[2]}']) AS regime, unnest([raw, alt, raw * alt]) AS score FROM v_test),
q AS (SELECT task, sample_id, y, regime, repeat_index, p.score * 0.5::DOUBLE + alt * repeat_index * 0.125::DOUBLE AS score FROM p CROSS JOIN (SELECT unnest(range(5)) AS repeat_index)),
{totals('q', 'task, repeat_index, regime', 'score')}, {metrics('task, repeat_index, regime')}, dl AS ({_delta})
SELECT task, 1.0::DOUBLE AS learning_fraction, comparison_id, comparator_regime, reference_regime, metric, count(*) AS repeat_n, round(avg(v) + 1.3e-9, 6) AS delta_mean, round(median(v) + 1.3e-9, 6) AS delta_median,
  round(stddev_samp(v) + 1.3e-9, 6) AS delta_sd, round(quantile_cont(v, 0.025) + 1.3e-9, 6) AS repeat_distribution_q025, round(quantile_cont(v, 0.975) + 1.3e-9, 6) AS repeat_distribution_q975, avg((v > 0)::INT) AS fraction_delta_gt_zero
FROM dl GROUP BY task, comparison_id, comparator_regime, reference_regime, metric"""
ORACLES["regime_summary"] = f"""{BASE}, {WINDOWS}, tc AS (SELECT * FROM v_cohort WHERE role = 'test'), {totals('tc', 'cohort, task, site_id', 'raw')}, {metrics('cohort, task, site_id')}
SELECT cohort, site_id, count(DISTINCT task) AS task_n, round(median(auroc) + 1.3e-9, 6) AS median_auroc, round(median(auprc) + 1.3e-9, 6) AS median_auprc FROM met
WHERE positive_n + negative_n >= 100 AND least(positive_n, negative_n) >= 20 GROUP BY ALL"""
ORACLES["tolerance_regression"] = f"""{BASE}, {totals('v_sample', 'task, year', 'raw')}, {metrics('task, year')},
a AS (SELECT task, year, 'positive_n' AS field, positive_n::DOUBLE AS v, NULL AS t FROM met UNION ALL SELECT task, year, 'negative_n', negative_n, NULL FROM met UNION ALL SELECT task, year, 'auroc', auroc, NULL FROM met
  UNION ALL SELECT task, year, 'brier', brier, NULL FROM met UNION ALL SELECT task, year, 'note', NULL, 'note_' || year FROM met),
b AS (SELECT task, year, field, CASE WHEN year = 1996 AND field = 'positive_n' THEN v + 1 WHEN year = 1997 AND field = 'auroc' THEN v + 1e-3::DOUBLE WHEN year = 1998 AND field = 'brier' THEN NULL ELSE v END AS v,
    CASE WHEN field = 'note' AND year = 1999 THEN 'other' ELSE t END AS t FROM a WHERE year <> 1995)
SELECT a.task, a.year, a.field, round(b.v + 1.3e-9, 6) AS frozen_value, round(a.v + 1.3e-9, 6) AS reproduced_value, b.t AS frozen_text, a.t AS reproduced_text,
  CASE WHEN a.field = 'note' THEN NULL WHEN a.v IS NULL OR b.v IS NULL THEN -1 ELSE round(abs(a.v - b.v) + 1.3e-9, 6) END AS absolute_difference,
  CASE WHEN a.field = 'note' THEN CASE WHEN a.t IS NOT DISTINCT FROM b.t THEN 'PASS' ELSE 'FAIL' END
    WHEN a.year = 1996 AND a.field = 'positive_n' THEN 'CORRECTED_FROZEN_METADATA'
    WHEN a.v IS NULL OR b.v IS NULL THEN 'FAIL' WHEN abs(a.v - b.v) <= CASE WHEN a.field IN ('positive_n', 'negative_n') THEN 0 ELSE 1e-10 END THEN 'PASS' ELSE 'FAIL' END AS status
FROM a LEFT JOIN b ON a.task = b.task AND a.year = b.year AND a.field = b.field"""
ORACLES["calibration_parameters"] = """SELECT n_nationkey AS task, n_name AS cohort_id, round(min_by(s_acctbal, s_suppkey), 2) AS platt_slope
FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL"""

# --- checks ------------------------------------------------------------------------------------


def finding(name: str, rows: str, count: str = "count(*)", example: str = "e") -> str:
    """One check row from violating rows with an example column ``e``."""
    return f"""SELECT '{name}' AS check_name, coalesce({count}, 0)::BIGINT AS violations, CASE WHEN coalesce({count}, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  coalesce(array_to_string(list_sort(list(DISTINCT e::VARCHAR))[1:5], ','), '') AS examples FROM ({rows})"""


ORACLES["protocols_disjoint"] = f"{BASE}, {WINDOWS} " + " UNION ALL ".join(
    finding(f"disjoint:{c}", f"SELECT sample_id AS e FROM v_cohort WHERE cohort = '{c}' GROUP BY sample_id HAVING count(DISTINCT role) > 1")
    for c in ("A_pre_marker_to_post_marker", "B_post_marker_current_temporal", "C_pooled_history_temporal")
)
_spl = """v_split AS (SELECT 'p' AS protocol, site_id, task, CASE WHEN sample_id % 500 = 0 THEN sample_id + 1 ELSE sample_id END AS sample_id,
  CASE WHEN sample_id % 700 = 0 THEN 'holdout' WHEN year < 2000 THEN 'train' ELSE 'test' END AS split FROM v_sample)"""
ORACLES["release_checks"] = f"{BASE}, {_spl} " + " UNION ALL ".join([
    finding("sample_key", "SELECT sample_id AS e, count(*) AS n FROM v_sample GROUP BY 1 HAVING n > 1", "sum(n)"),
    finding("label_key", "SELECT concat_ws('|', site_id, sample_id, task) AS e, count(*) AS n FROM v_sample GROUP BY 1 HAVING n > 1", "sum(n)"),
    finding("split_key", "SELECT concat_ws('|', protocol, site_id, task, sample_id) AS e, count(*) AS n FROM v_split GROUP BY 1 HAVING n > 1", "sum(n)"),
    finding("label_category", "SELECT sample_id AS e FROM v_sample WHERE sir NOT IN ('S', 'I', 'R')"),
    finding("label_binary", "SELECT sample_id AS e FROM v_sample WHERE y NOT IN (0, 1)"),
    finding("split_value", "SELECT sample_id AS e FROM v_split WHERE split NOT IN ('train', 'validation', 'test', 'early_70', 'late_30')"),
    finding("label_sample_known", "SELECT DISTINCT sample_id AS e FROM v_sample WHERE sample_id NOT IN (SELECT o_orderkey FROM orders)"),
    finding("split_sample_known", "SELECT DISTINCT sample_id AS e FROM v_split WHERE sample_id NOT IN (SELECT sample_id FROM v_sample)"),
    finding("label_task_known", "SELECT DISTINCT task AS e FROM v_sample WHERE task = '5-LOW'"),
])
_key = "concat_ws('|', task, sample_id)"
_ck = f"CASE WHEN {usable('cluster_id')} THEN concat_ws('|', task, cluster_id) END"
ORACLES["label_sample_join"] = f"{BASE} SELECT l_orderkey AS sample_id, l_linenumber, l_returnflag AS category, site_id, feature_row FROM lineitem JOIN v_sample ON l_orderkey = sample_id"
ORACLES["score_pairs"] = f"{BASE} SELECT task, sample_id, raw, alt FROM v_test"
ORACLES["split_rows"] = f"{BASE} SELECT task, sample_id, CASE WHEN year < 2000 THEN 'train' ELSE 'test' END AS split, y, d FROM v_sample WHERE year >= 1998"
ORACLES["join_findings"] = f"{BASE}, k AS (SELECT sample_id FROM v_sample WHERE sample_id % 97 <> 0), l AS (SELECT DISTINCT l_orderkey AS s FROM lineitem) " + " UNION ALL ".join([
    finding("labels:left_without_right", "SELECT s AS e FROM l WHERE s NOT IN (SELECT sample_id FROM k)"),
    finding("labels:right_key", "SELECT sample_id AS e, count(*) AS n FROM k GROUP BY 1 HAVING n > 1", "sum(n)"),
    finding("samples:left_without_right", "SELECT s AS e FROM l WHERE s NOT IN (SELECT sample_id FROM v_sample)"),
    finding("samples:right_key", "SELECT sample_id AS e, count(*) AS n FROM v_sample GROUP BY 1 HAVING n > 1", "sum(n)"),
    finding("samples:left_key", "SELECT s AS e, count(*) AS n FROM l GROUP BY 1 HAVING n > 1", "sum(n)"),
    finding("samples:right_without_left", "SELECT sample_id AS e FROM v_sample WHERE sample_id NOT IN (SELECT s FROM l)"),
])
ORACLES["union_of_parts"] = f"{BASE} SELECT task, sample_id, CASE WHEN site_id = 'A' THEN raw END AS raw, CASE WHEN site_id = 'B' THEN alt END AS alt FROM v_sample"
ORACLES["leakage_checks"] = f"""{BASE}, {month_folds('v_dev', 'mf')}, ev AS (SELECT {_key} AS k, {_ck} AS c FROM v_sample WHERE d >= DATE '1999-12-20'), dv AS (SELECT {_key} AS k, {_ck} AS c, task, y FROM v_dev),
fo AS (SELECT {_key} AS k, {_ck} AS c, task, fold_index, split, y FROM mf_rows) """ + " UNION ALL ".join([
    finding("train_validation_clusters_disjoint", "SELECT concat_ws('|', task, fold_index, substr(c, length(task) + 2)) AS e FROM fo WHERE c IS NOT NULL GROUP BY task, fold_index, c HAVING count(DISTINCT split) > 1"),
    finding("development_evaluation_clusters_disjoint", "SELECT DISTINCT c AS e FROM dv WHERE c IN (SELECT c FROM ev WHERE c IS NOT NULL)"),
    finding("fold_evaluation_clusters_disjoint", "SELECT DISTINCT c AS e FROM fo WHERE c IN (SELECT c FROM ev WHERE c IS NOT NULL)"),
    finding("development_key", "SELECT k AS e, count(*) AS n FROM dv GROUP BY 1 HAVING n > 1", "sum(n)"),
    finding("development_both_classes", "SELECT task AS e FROM dv GROUP BY 1 HAVING NOT (min(y) = 0 AND max(y) = 1)"),
    finding("at_least_two_folds", "SELECT t.task AS e FROM (SELECT DISTINCT task FROM dv) t LEFT JOIN fo ON t.task = fo.task GROUP BY 1 HAVING count(DISTINCT fold_index) < 2"),
    finding("fold_split_value", "SELECT k AS e FROM fo WHERE split NOT IN ('train', 'validation')"),
    finding("fold_inside_development", "SELECT DISTINCT k AS e FROM fo WHERE k NOT IN (SELECT k FROM dv)"),
    finding("fold_both_classes", "SELECT concat_ws('|', task, fold_index, split) AS e FROM fo GROUP BY 1 HAVING NOT (min(y) = 0 AND max(y) = 1)"),
    finding("train_validation_disjoint", "SELECT k AS e FROM fo GROUP BY k, fold_index HAVING count(DISTINCT split) > 1"),
    finding("validation_once", "SELECT k AS e, count(*) AS n FROM fo WHERE split = 'validation' GROUP BY 1 HAVING n > 1", "sum(n)"),
    finding("development_evaluation_disjoint", "SELECT k AS e FROM dv WHERE k IN (SELECT k FROM ev)"),
    finding("fold_evaluation_disjoint", "SELECT DISTINCT k AS e FROM fo WHERE k IN (SELECT k FROM ev)"),
])
ORACLES["contiguous_rows"] = f"""{BASE}, n AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY d, sample_id) - 1 AS r FROM v_sample), b AS (SELECT * FROM n WHERE task <> '2-HIGH' OR r <> 7)
""" + finding("row_numbers", "SELECT task AS e FROM b GROUP BY task HAVING NOT (count(*) = count(DISTINCT r) AND min(r) = 0 AND max(r) = count(*) - 1)")
_pa = ORACLES["purge_audits"].split("counted AS", 1)
ORACLES["preflight"] = f"""{BASE}, {WINDOWS}, marked AS ({_marked}), counted AS {_pa[1].split('SELECT *,', 1)[0]},
audit AS (SELECT *, {_status} AS support_status, CASE WHEN {_status} = 'adequate' THEN 'PASS' ELSE 'FAIL' END AS purge_status FROM counted WHERE mode = 'strict'),
c AS (SELECT cohort, role, task, {_COUNTS} FROM v_cohort GROUP BY ALL)
SELECT 'test_disjoint_support' AS gate, task, purge_status AS status, concat('{{"n_after":', n_after, ',"n_before":', n_before, ',"negative_after_n":', negative_after_n, ',"negative_before_n":', negative_before_n,
  ',"positive_after_n":', positive_after_n, ',"positive_before_n":', positive_before_n, ',"purge_status":"', purge_status, '","removed_missing_cluster_n":', removed_missing_cluster_n,
  ',"removed_overlap_n":', removed_overlap_n, ',"support_status":"', support_status, '","task":"', task, '"}}') AS detail FROM audit
UNION ALL SELECT concat('cohort_support:', cohort, ':', role), task, CASE WHEN {_gs} = 'adequate' THEN 'PASS' ELSE 'WARN' END, {_gr} FROM c
UNION ALL SELECT 'target_date_coverage', 'ALL', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END, concat('labelled_samples_without_target_date=', count(*)) FROM v_sample WHERE site_id = 'B' AND month(d) = 2"""
_d1, _e1 = annual("n", "positive_n", "negative_n", 100, 20)
_d2, _e2 = annual("n", "positive_n", "negative_n", 30, 10)
_cc = "SELECT task, count(*) AS n, count_if(y = 1)::BIGINT AS positive_n, count_if(y = 0)::BIGINT AS negative_n"
ORACLES["task_support"] = f"""{BASE}, a AS ({_cc} FROM v_dev GROUP BY task), b AS ({_cc} FROM v_test GROUP BY task)
SELECT 'development' AS role, *, {_d1} AS status, {_e1} AS reason FROM a UNION ALL SELECT 'test', *, {_d2}, {_e2} FROM b"""
TREE = """h4 AS (SELECT {k}, substr(h, 1, 4) AS p4, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM hs GROUP BY ALL),
h2 AS (SELECT {k}, substr(p4, 1, 2) AS p2, sha256(string_agg(p4 || d, '' ORDER BY p4)) AS d, sum(n) AS n FROM h4 GROUP BY ALL),
tree AS (SELECT {k}, sha256(string_agg(p2 || d, '' ORDER BY p2)) AS tree_sha256, sum(n)::BIGINT AS n FROM h2 GROUP BY ALL)"""
_text = "concat_ws('{s}', sample_id::VARCHAR, coalesce(cluster_id, '<NA>'), y::VARCHAR)"
ORACLES["membership_hash"] = f"""{BASE}, r AS (SELECT task, year, concat_ws(chr(9), row_number() OVER (PARTITION BY task, year ORDER BY d, sample_id) - 1, {_text.format(s=chr(9))}) AS t FROM v_sample),
hs AS (SELECT task, year, sha256(t) AS h FROM r), {TREE.format(k='task, year')} SELECT * FROM tree"""
ORACLES["fold_hash"] = f"""{BASE}, {month_folds('v_dev', 'mf')}, hs AS (SELECT task, sha256(concat_ws(chr(9), fold_index::VARCHAR, split, sample_id::VARCHAR)) AS h FROM mf_rows), {TREE.format(k='task')} SELECT * FROM tree"""
ORACLES["membership_hash_large"] = f"{BASE}, hs AS (SELECT site_id, sha256({_text.format(s='|')}) AS h FROM v_sample), {TREE.format(k='site_id')} SELECT * FROM tree"
_RX = {
    "mac_absolute_home": r"/Users/[A-Za-z0-9._-]+/", "linux_absolute_home": r"/home/[A-Za-z0-9._-]+/", "windows_absolute_path": r"\b[A-Za-z]:\\[^\s]+",
    "private_ipv4": r"\b(?:10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})\b",
    "email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+", "digit_groups": r"[0-9]{3}-[0-9]{3,4}",
}
ORACLES["pattern_audit_texts"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{src}' AS source, {key} AS row_id, '{n}' AS pattern, len(regexp_extract_all({text}, '{rx}'))::BIGINT AS match_n FROM {src}"
    for src, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html")) for n, rx in _RX.items()
) + ") WHERE match_n > 0"


def newton(source: str, keys: str, x: str, steps: int = 12) -> str:
    """CTEs ending in fit(keys, slope, intercept): Newton steps of a logistic line, written out one by one."""
    on = " AND ".join(f"p.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    cols = ", ".join("q." + k.strip() for k in keys.split(","))
    ctes = [
        f"pt AS (SELECT {keys}, {x} AS x, count_if(y = 1)::DOUBLE AS pos, count_if(y = 0)::DOUBLE AS neg FROM {source} GROUP BY ALL)",
        f"fit0 AS (SELECT {keys}, 0::DOUBLE AS b, ln(sum(pos) / sum(neg)) AS a FROM pt GROUP BY {keys})",
    ]
    for i in range(steps):
        ctes.append(
            f"sum{i} AS (SELECT {cols}, any_value(b) AS b, any_value(a) AS a, sum(((pos + neg) * m - pos) * x) + 1e-6 * any_value(b) AS g1, sum((pos + neg) * m - pos) AS g0, "
            f"sum((pos + neg) * m * (1 - m) * x * x) + 1e-6 AS h11, sum((pos + neg) * m * (1 - m) * x) AS h10, sum((pos + neg) * m * (1 - m)) AS h00 "
            f"FROM (SELECT {cols}, q.b, q.a, x, pos, neg, 1 / (1 + exp(-(q.b * x + q.a))) AS m FROM pt p JOIN fit{i} q ON {on}) q GROUP BY {cols})"
        )
        ctes.append(
            f"fit{i + 1} AS (SELECT {keys}, b - (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10) AS b, a - (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) AS a FROM sum{i})"
        )
    last = f"abs(p.b - q.b) + abs(p.a - q.a) < 1e-9"
    return ", ".join(ctes) + f", fit AS (SELECT {cols}, q.b AS slope, q.a AS intercept, {last} AS converged FROM fit{steps - 1} p JOIN fit{steps} q ON {on})"


_LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, raw)) / (1 - greatest(1e-6, least(1 - 1e-6, raw))))"
ORACLES["calibration_slope"] = f"{BASE}, {newton('v_sample', 'task, site_id', _LOGIT)} SELECT task, site_id, {rnd('slope, intercept')}, converged FROM fit"
ORACLES["platt_calibration"] = f"""{BASE}, {newton('v_dev', 'task', _LOGIT)},
g AS (SELECT *, slope > 0 AS ok FROM fit), s AS (SELECT t.task, CASE WHEN ok THEN 1 / (1 + exp(-(slope * {_LOGIT} + intercept))) END AS c FROM v_test t JOIN g ON t.task = g.task)
SELECT s.task, count(*) AS n, count(c) AS calibrated_n, round(avg(c) + 1.3e-9, 6) AS mean_probability, round(any_value(slope) + 1.3e-9, 6) AS platt_slope,
  round(any_value(intercept) + 1.3e-9, 6) AS platt_intercept, CASE WHEN any_value(ok) THEN 'ok' ELSE 'failed' END AS calibration_status,
  CASE WHEN any_value(ok) THEN '' ELSE 'nonpositive_platt_slope' END AS calibration_failure_reason FROM s JOIN g ON s.task = g.task GROUP BY s.task"""

# --- plan of three protocol families -------------------------------------------------------------

_REGIMES = ("pre_marker_history_only", "current_workflow_only", "pooled_pre_and_current")
_das, _dar = annual("n_development", "development_positive_n", "development_negative_n", 100, 20)
_pas, _par = annual("n_primary", "primary_positive_n", "primary_negative_n", 100, 20)
_tgs, _tgr = graded("n_test", "test_positive_n", "test_negative_n", 100, 20)
_contract_reason = """CASE WHEN n_development = 0 THEN 'no_samples' WHEN least(development_positive_n, development_negative_n) = 0 THEN 'single_class'
  WHEN n_development < 100 THEN 'n<100' WHEN least(development_positive_n, development_negative_n) < 20 THEN 'min_class<20' ELSE '' END"""
_tally = lambda p: f"count(*) AS n_{p}, count_if(y = 1)::BIGINT AS {p}_positive_n, count_if(y = 0)::BIGINT AS {p}_negative_n"
_fold_of = "SELECT '{cell}' AS cell, task, fold_index, sample_id, cluster_id, y, split FROM {rows}"
ORACLES["sensitivity_plan"] = f"""{BASE}, {YEAR_FOLDS},
tasks AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS task),
years AS (SELECT unnest(range(1996, 2003)) AS ty),
spine AS (
  SELECT 'annual' AS family, task, ty::VARCHAR AS cell, c.cohort_id, c.is_primary, 'development_and_primary' AS gate FROM tasks, years, (VALUES ('entity_disjoint', true), ('all_samples', false)) c(cohort_id, is_primary)
  UNION ALL SELECT 'training_history', task, r.cell, c.cohort_id, c.is_primary, 'development' FROM tasks, (SELECT unnest({list(_REGIMES)}) AS cell) r, (VALUES ('common_entity_disjoint', true), ('common_all_samples', false)) c(cohort_id, is_primary)
  UNION ALL SELECT 'cross_site', task, 'source', c.cohort_id, c.is_primary, 'development' FROM tasks,
    (VALUES ('source_entity_disjoint', true), ('source_all_samples', false), ('target_primary', false), ('target_full_period', false)) c(cohort_id, is_primary)),
v_use AS (SELECT * FROM v_sample WHERE {usable('cluster_id')}),
v_pre AS (SELECT * FROM v_use WHERE d < DATE '1998-01-01'), v_cur AS (SELECT * FROM v_use WHERE d BETWEEN DATE '1998-02-01' AND DATE '1999-12-31'),
v_src AS (SELECT * FROM v_dev WHERE site_id = 'A'), v_late AS (SELECT * FROM v_test WHERE {usable('cluster_id')}),
{month_folds('v_pre', 'pf')}, {month_folds('v_cur', 'hf')}, {month_folds('v_src', 'sf')},
r AS ({_fold_of.format(cell=_REGIMES[0], rows='pf_rows')} UNION ALL {_fold_of.format(cell=_REGIMES[1], rows='hf_rows')} UNION ALL {_fold_of.format(cell=_REGIMES[2], rows='hf_rows')}
  UNION ALL SELECT '{_REGIMES[2]}', p.task, f.fold_index, p.sample_id, p.cluster_id, p.y, 'train' FROM v_pre p JOIN (SELECT DISTINCT task, fold_index FROM hf_rows) f ON p.task = f.task
  UNION ALL {_fold_of.format(cell='source', rows='sf_rows')}),
seen AS (SELECT DISTINCT cell, task, fold_index, cluster_id FROM r WHERE split = 'train' AND cluster_id IS NOT NULL),
kept AS (SELECT r.* FROM r WHERE split = 'validation' AND {usable('cluster_id')}
  AND NOT EXISTS (SELECT 1 FROM seen x WHERE x.cell = r.cell AND x.task = r.task AND x.fold_index = r.fold_index AND x.cluster_id = r.cluster_id)),
ft AS (SELECT cell, task, fold_index, count(*) AS n, least(count_if(y = 1), count_if(y = 0)) AS c FROM r WHERE split = 'train' GROUP BY ALL),
fv AS (SELECT cell, task, fold_index, count(*) AS n, least(count_if(y = 1), count_if(y = 0)) AS c FROM kept GROUP BY ALL),
valid AS (
  SELECT CASE WHEN cell = 'source' THEN 'cross_site' ELSE 'training_history' END AS family, task, cell, count(*) AS valid_fold_n
  FROM ft JOIN fv USING (cell, task, fold_index) WHERE ft.n >= 20 AND ft.c >= 10 AND fv.n >= 10 AND fv.c >= 5 GROUP BY ALL
  UNION ALL SELECT 'annual', task, ty::VARCHAR, count(*) FROM yf_audit JOIN years ON validation_year < ty WHERE status = 'adequate' GROUP BY ALL),
dev AS (
  SELECT 'annual' AS family, task, ty::VARCHAR AS cell, cluster_id, y FROM v_sample JOIN years ON year < ty
  UNION ALL SELECT 'training_history', task, '{_REGIMES[0]}', cluster_id, y FROM v_pre UNION ALL SELECT 'training_history', task, '{_REGIMES[1]}', cluster_id, y FROM v_cur
  UNION ALL SELECT 'training_history', task, '{_REGIMES[2]}', cluster_id, y FROM v_pre UNION ALL SELECT 'training_history', task, '{_REGIMES[2]}', cluster_id, y FROM v_cur
  UNION ALL SELECT 'cross_site', task, 'source', cluster_id, y FROM v_src),
trained AS (SELECT DISTINCT task, cluster_id FROM dev WHERE family = 'training_history'),
first AS (SELECT task, cluster_id, min(year) AS fy FROM v_use GROUP BY ALL),
cells AS (SELECT DISTINCT task, cell FROM dev WHERE family = 'training_history'),
test AS (
  SELECT 'annual' AS family, task, year::VARCHAR AS cell, 'all_samples' AS cohort_id, y FROM v_sample WHERE year BETWEEN 1996 AND 2002
  UNION ALL SELECT 'annual', s.task, s.year::VARCHAR, 'entity_disjoint', y FROM v_use s JOIN first f ON f.task = s.task AND f.cluster_id = s.cluster_id AND f.fy >= s.year WHERE s.year BETWEEN 1996 AND 2002
  UNION ALL SELECT 'training_history', l.task, cell, 'common_all_samples', y FROM v_late l JOIN cells c ON c.task = l.task
  UNION ALL SELECT 'training_history', l.task, cell, 'common_entity_disjoint', y FROM v_late l JOIN cells c ON c.task = l.task WHERE NOT EXISTS (SELECT 1 FROM trained t WHERE t.task = l.task AND t.cluster_id = l.cluster_id)
  UNION ALL SELECT 'cross_site', task, 'source', 'source_all_samples', y FROM v_test WHERE site_id = 'A'
  UNION ALL SELECT 'cross_site', task, 'source', 'source_entity_disjoint', y FROM v_late l WHERE site_id = 'A' AND NOT EXISTS (SELECT 1 FROM v_src x WHERE x.task = l.task AND x.cluster_id = l.cluster_id)
  UNION ALL SELECT 'cross_site', task, 'source', 'target_primary', y FROM v_test WHERE site_id = 'B' UNION ALL SELECT 'cross_site', task, 'source', 'target_full_period', y FROM v_sample WHERE site_id = 'B'),
dc AS (SELECT family, task, cell, {_tally('development')} FROM dev GROUP BY ALL),
tc AS (SELECT family, task, cell, cohort_id, {_tally('test')} FROM test GROUP BY ALL),
pc AS (SELECT family, task, cell, n_test AS n_primary, test_positive_n AS primary_positive_n, test_negative_n AS primary_negative_n FROM tc JOIN spine USING (family, task, cell, cohort_id) WHERE is_primary),
j AS (SELECT * REPLACE (coalesce(n_development, 0) AS n_development, coalesce(development_positive_n, 0) AS development_positive_n, coalesce(development_negative_n, 0) AS development_negative_n,
    coalesce(valid_fold_n, 0) AS valid_fold_n, coalesce(n_test, 0) AS n_test, coalesce(test_positive_n, 0) AS test_positive_n, coalesce(test_negative_n, 0) AS test_negative_n,
    coalesce(n_primary, 0) AS n_primary, coalesce(primary_positive_n, 0) AS primary_positive_n, coalesce(primary_negative_n, 0) AS primary_negative_n)
  FROM spine LEFT JOIN dc USING (family, task, cell) LEFT JOIN valid USING (family, task, cell) LEFT JOIN pc USING (family, task, cell) LEFT JOIN tc USING (family, task, cell, cohort_id)),
k AS (SELECT *, gate = 'development_and_primary' AS strict, CASE WHEN gate = 'development' THEN CASE WHEN {_contract_reason} = '' THEN 'adequate' ELSE 'insufficient' END ELSE {_das} END AS development_status,
    CASE WHEN gate = 'development' THEN {_contract_reason} ELSE {_dar} END AS dr, {_pas} AS ps, {_par} AS pr FROM j),
g AS (SELECT *, development_status = 'adequate' AND valid_fold_n >= 2 AND (NOT strict OR ps = 'adequate') AS fits FROM k)
SELECT family, task, cell, cohort_id, is_primary, gate, n_development, development_positive_n, development_negative_n, development_status, valid_fold_n, n_test, test_positive_n, test_negative_n,
  {_tgs} AS support_status, fits, CASE WHEN fits AND least(test_positive_n, test_negative_n) > 0 THEN 'ok' ELSE 'insufficient' END AS status,
  CASE WHEN fits THEN {_tgr} ELSE concat_ws(';', nullif(dr, ''), CASE WHEN strict THEN nullif(pr, '') END, CASE WHEN valid_fold_n < 2 THEN 'valid_folds<2' END) END AS insufficient_reason
FROM g"""
