import pytest

from cohortlane.operators import contracts as K
from cohortlane.operators import joins as J
from cohortlane.operators import metrics as M


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "sample_id long, label string")
    samples = spark.createDataFrame([(1, 10), (2, None)], "sample_id long, row int")
    return labels, samples


def test_many_to_one(spark, tables):
    labels, samples = tables
    assert sorted(J.many_to_one(labels, samples, ["sample_id"]).collect()) == [(1, "a", 10), (1, "b", 10), (2, "c", None)]
    with pytest.raises(Exception, match="repeated key in the right side: 1"):
        J.many_to_one(labels, samples.union(samples), ["sample_id"]).collect()
    more = labels.union(spark.createDataFrame([(3, "d"), (None, "e")], labels.schema))
    with pytest.raises(Exception, match="row without a partner"):
        J.many_to_one(more, samples, ["sample_id"]).collect()
    assert J.many_to_one(more, samples, ["sample_id"], required=False).where("row is null").count() == 3
    with pytest.raises(ValueError, match="both sides"):
        J.many_to_one(labels, labels, ["sample_id"])


def test_one_to_one(spark, tables):
    _, samples = tables
    other = spark.createDataFrame([(2, 0.5), (1, 0.25)], "sample_id long, score double")
    assert sorted(J.one_to_one(samples, other, ["sample_id"]).collect()) == [(1, 10, 0.25), (2, None, 0.5)]
    for bad in (other.where("sample_id = 1"), other.union(spark.createDataFrame([(3, 0.1)], other.schema)), other.union(other), other.selectExpr("nullif(sample_id, 2) sample_id", "score")):
        with pytest.raises(Exception, match="repeated key|without a partner"):
            J.one_to_one(samples, bad, ["sample_id"]).collect()


def test_join_checks(spark, tables):
    labels, samples = tables
    found = {r.check_name: (r.violations, r.examples) for r in J.join_checks(labels, samples.where("sample_id = 1"), ["sample_id"], "1:1", "x").collect()}
    assert found == {"x:left_without_right": (1, "2"), "x:right_key": (0, ""), "x:left_key": (2, "1"), "x:right_without_left": (0, "")}
    with pytest.raises(ValueError):
        J.join_checks(labels, samples, ["sample_id"], "n:m", "x")


def test_split_rows_must_exist(spark, tables):
    _, samples = tables
    splits = spark.createDataFrame([(1, "train")], "sample_id long, split string")
    assert J.split_join(samples, splits, ["sample_id"]).collect() == [(1, "train", 10)]
    with pytest.raises(Exception, match="without a partner"):
        J.split_join(samples, spark.createDataFrame([(9, "test")], splits.schema), ["sample_id"]).collect()


def test_union_of_parts(spark):
    one, two = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, 0.5)], "k int, b double")
    assert sorted(J.union_parts([one, two], ["k"]).collect()) == [(1, "x", None), (2, None, 0.5)]
    assert J.union_parts([], ["k"], "k int, a string").columns == ["k", "a"]
    with pytest.raises(Exception, match="repeated key in the union"):
        J.union_parts([one, one], ["k"]).collect()


def test_clusters_on_both_sides_are_found(spark):
    schema = "task string, sample_id long, cluster_id string, y int"
    development = spark.createDataFrame([("t", k, f"c{k // 2}", k % 2) for k in range(8)], schema)
    folds = spark.createDataFrame(
        [("t", 0, "train" if k < 3 else "validation", k, f"c{k // 2}", k % 2) for k in range(6)] + [("t", 1, "train" if k < 6 else "validation", k, None, k % 2) for k in range(8)],
        "task string, fold_index int, split string, sample_id long, cluster_id string, y int",
    )
    evaluation = spark.createDataFrame([("t", 100, "c3", 1), ("t", 101, None, 0)], schema)
    found = {r.check_name: (r.violations, r.examples) for r in K.development_contract(development, folds, evaluation).collect()}
    assert found["train_validation_clusters_disjoint"] == (1, "t|0|c1") and found["development_evaluation_clusters_disjoint"] == (1, "t|c3")
    assert found["fold_evaluation_clusters_disjoint"] == (0, "")


@pytest.mark.parametrize("score, y", [(1.7, 1), (float("nan"), 0), (-0.5, 0), (None, 1), (0.5, 2), (0.5, None)])
def test_bad_scores_and_labels_fail(spark, score, y):
    rows = spark.createDataFrame([("g", 0.4, 1), ("g", 0.3, 0), ("g", score, y)], "g string, score double, y int")
    for measure in (M.score_metrics, M.operating_points):
        with pytest.raises(Exception, match="score outside"):
            measure(rows, ["g"]).collect()


def test_registered_union_has_one_row_per_key(spark):
    from cohortlane.plans import views as V
    from cohortlane.plans.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    got = QUERIES["union_of_parts"](spark, folder)
    assert got.columns == ["task", "sample_id", "raw", "alt"]
    rows, whole = got.collect(), V.samples(spark, folder).select("task", "sample_id").collect()
    assert sorted((r.task, r.sample_id) for r in rows) == sorted(map(tuple, whole))
    assert all((r.raw is None) != (r.alt is None) for r in rows)
