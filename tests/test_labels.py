import pytest
from pyspark.sql import functions as F

from cohortlane.functions import columns as X
from cohortlane.functions.identity import map_alias, normalize_identity
from cohortlane.operators import labels as L
from cohortlane.plans import views as V
from cohortlane.plans.audit import label_audit

SCHEMA = "site_id string, sample_id string, year int, organism string, drug_code string, drug_name string, sir string, conflict boolean, core_task string, n int"
ROWS = [
    ("A", "s1", 2020, "Kp", "FEP", "Cefepime", "S", False, "T00", 1),
    ("A", "s1", 2020, " kp ", "fep", "cefepime", "S", False, "T00", 2),   # same identity, same label
    ("A", "s2", 2021, "Kp", "FEP", "Cefepime", "R", False, "T00", 3),
    ("A", "s3", 2021, "Kp", "FEP", "Cefepime", "I", False, "T00", 4),
    ("A", "s4", 2021, "Kp", "FEP", "Cefepime", "S", False, "T00", 5),
    ("A", "s4", 2021, "Kp", "FEP", "Cefepime", "R", False, "T00", 6),     # two categories: conflict
    ("A", "s5", 2021, "Kp", "FEP", "Cefepime", "x", False, "", 7),        # no category
    ("A", "s6", 2021, "", "FEP", "Cefepime", "S", False, "", 8),          # no organism
    ("A", "s7", 2019, "Kp", None, "Ceftazidime", "S", True, "", 9),       # source conflict
]
PANEL = [dict(task_id=f"T{i:02d}", category="literature_anchor" if i < 3 else "local_extension", evidence="e" if i else "") for i in range(10)]


@pytest.fixture(scope="module")
def audit(spark):
    labels = spark.createDataFrame(ROWS, SCHEMA)
    samples = spark.createDataFrame([(f"s{i}", i if i != 3 else -1) for i in range(1, 8)], "sample_id string, feature_row long")
    return label_audit(labels, samples, ["n"], PANEL, L.SupportThresholds(2, 2, 1))


def test_funnel_counts(audit):
    rows = audit.funnel.orderBy("step_order").collect()
    assert [r.label_rows for r in rows] == [9, 8, 6, 4, 3, 2, 2, 2, 2]
    assert [r.unique_sample_n for r in rows] == [7, 6, 6, 4, 3, 2, 2, 2, 2]
    assert [r.combination_n for r in rows] == [None, 2, 2, 1, 1, 1, 1, 1, 1]
    assert (rows[5].positive_n, rows[5].negative_n) == (1, 1)


def test_inventory(audit):
    rows = {r.name_key: r for r in audit.inventory.collect()}
    fep = rows["cefepime"]
    assert (fep.raw_sample_combination_n, fep.conflict_n, fep.conflict_free_sir_n, fep.feature_linked_label_n) == (5, 1, 3, 2)
    assert fep.support_eligible and fep.years == "2020|2021" and fep.core_task_ids == "T00"
    assert fep.organism_values == "Kp" and fep.drug_code_values == "FEP"
    taz = rows["ceftazidime"]
    assert not taz.support_eligible and taz.support_exclusion_reasons == "min_years|min_total|min_class"
    assert taz.positive_rate is None


def test_mapping_keeps_unmatched_tasks(audit):
    rows = {r.task_id: r for r in audit.mapping.collect()}
    assert len(rows) == 10 and rows["T00"].exact_combination_n == 1 and rows["T05"].exact_combination_n == 0
    assert rows["T00"].author_input_needed and not rows["T01"].author_input_needed


def test_panel_contract():
    with pytest.raises(ValueError):
        L.check_panel(PANEL[:9])
    with pytest.raises(ValueError):
        L.check_panel([dict(t, category="local_extension") for t in PANEL])


def test_year_that_is_no_number_fails(spark):
    bad = spark.createDataFrame([("A", "x20")], "site_id string, year string")
    with pytest.raises(Exception, match="non-numeric years"):
        L.scope_labels(bad).collect()


def test_two_core_tasks_in_one_group_fail(spark):
    rows = [("A", "s1", 2020, "Kp", "F", "F", "S", False, t, i) for i, t in enumerate(["T00", "T01"])]
    scoped = L.normalize_labels(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(Exception, match="several core tasks"):
        L.collapse_labels(scoped, ["n"]).collect()


def test_identity_forms(spark):
    texts = ["Ｃｅｆｅｐｉｍｅ", " a 　 B\t\x1c c", "Straße", None, "ceftazidime-avibactam", "头孢吡肟（马斯平）", "ceftazidime"]
    got = normalize_identity(spark.createDataFrame([(t,) for t in texts], "t string"), {"t": "k"}).select("t", "k", map_alias("k").alias("a"))
    by_text = {r.t: (r.k, r.a) for r in got.collect()}
    assert by_text["Ｃｅｆｅｐｉｍｅ"] == ("cefepime", "cefepime")
    assert by_text[" a 　 B\t\x1c c"] == ("a b c", "")
    assert by_text["Straße"] == ("strasse", "")
    assert by_text[None] == ("", "")
    assert by_text["ceftazidime-avibactam"] == ("ceftazidime-avibactam", "")
    assert by_text["头孢吡肟（马斯平）"][1] == "cefepime"


def test_seed_in_column_and_driver_agree(spark):
    row = spark.range(1).select(X.derived_seed(7, F.lit("a"), F.lit(3)).alias("s")).first()
    assert row.s == X.derived_seed_value(7, "a", 3)


def test_agreement(spark):
    rows = [("t", "S", "S", 0.0, 0.0, False), ("t", "R", "S", 1.0, 0.0, True), ("t", "I", "", 1.0, None, None)]
    cols = "task_id string, historical_sir string, harmonized_sir string, historical_y double, harmonized_y double, reclassified boolean"
    r = L.label_agreement(spark.createDataFrame(rows, cols)).first()
    assert (r.total_labels, r.interpreted_n, r.unsupported_n, r.reclassified_n) == (3, 2, 1, 1)
    assert (r.binary_agreement, r.exact_agreement) == (0.5, 0.5)


def test_panel_of_the_views_is_valid():
    L.check_panel(V.PANEL)


def test_collapsed_rows_are_stored_by_columns(spark):
    from cohortlane.plans import views as V
    from cohortlane.plans.audit import label_audit
    from cohortlane.plans.registry import SCOPE, collapsed

    folder = "/root/testdata/sf0.001"
    stored = label_audit(V.ast_labels(spark, folder), V.samples(spark, folder), V.LABEL_ORDER, V.PANEL, **SCOPE).collapsed
    assert stored.inputFiles() and all(f.endswith(".parquet") for f in stored.inputFiles())
    assert stored.columns == collapsed(spark, folder).columns
    assert sorted(map(str, stored.collect())) == sorted(map(str, collapsed(spark, folder).collect()))
