import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cohortlane.operators import cohorts as C
from cohortlane.operators.compare import fold_digest, membership_digest, row_ordinal, row_text, tree_digest


def ids(df, column="sample_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_default_protocols(spark):
    days = [date(2025, 6, 22), date(2025, 6, 23), date(2025, 7, 1), date(2026, 2, 28), date(2026, 3, 1), date(2026, 6, 10)]
    df = spark.createDataFrame(list(zip("abcdef", days)), "sample_id string, d date")
    out = C.assign_windows(df, C.ProtocolDates().protocols())
    pick = lambda p, role: ids(out.where((F.col("cohort").startswith(p)) & (F.col("role") == role)))
    assert pick("A", "development") == ["a"] and pick("A", "test") == ["c", "d", "e"]
    assert pick("B", "development") == ["c", "d"] and pick("B", "test") == ["e"]
    assert pick("C", "development") == ["a", "c", "d"] and pick("C", "test") == ["e"]


@pytest.mark.parametrize("mode, kept, overlap, missing", [("strict", 2, 1, 1), ("annual", 2, 1, 1), ("simple", 2, 1, 1)])
def test_purge_modes_on_null(spark, mode, kept, overlap, missing):
    train = spark.createDataFrame([(i, f"P{i}") for i in range(1, 5)], "sample_id long, cluster_id string")
    test = spark.createDataFrame([(11, "P2", 1), (12, "P5", 0), (13, None, 1), (14, "P6", 1)], "sample_id long, cluster_id string, y int")
    r = C.purge_audit(C.mark_purge(train, test, mode=mode), []).first()
    assert (r.n_after, r.removed_overlap_n, r.removed_missing_cluster_n) == (kept, overlap, missing)


def test_purge_modes_differ_on_blank(spark):
    train = spark.createDataFrame([(1, ""), (2, "P1")], "sample_id long, cluster_id string")
    test = spark.createDataFrame([(3, "", 1), (4, None, 1), (5, "P9", 0)], "sample_id long, cluster_id string, y int")
    counts = lambda mode: tuple(C.purge_audit(C.mark_purge(train, test, mode=mode), []).select("removed_overlap_n", "removed_missing_cluster_n", "n_after").first())
    assert counts("strict") == (0, 2, 1)
    assert counts("annual") == (2, 2, 1)
    assert counts("simple") == (1, 1, 1)


def test_purge_by_task_and_sample_id_that_looks_like_a_cluster(spark):
    train = spark.createDataFrame([(1, "a", "7")], "sample_id long, task string, cluster_id string")
    test = spark.createDataFrame([(7, "a", None), (8, "b", "7"), (9, "a", "7")], "sample_id long, task string, cluster_id string")
    marked = {r.sample_id: r for r in C.mark_purge(train, test, ["task"]).collect()}
    assert not marked[7].cluster_overlap and marked[7].cluster_missing
    assert marked[8].kept and marked[9].cluster_overlap


SUPPORT = [
    ("graded", (120, 30, 90), ("adequate", "")), ("graded", (80, 15, 65), ("exploratory_or_insufficient", "n<100;min_class<20")),
    ("graded", (50, 0, 50), ("insufficient", "single_class")), ("graded", (0, 0, 0), ("insufficient", "no_samples")),
    ("annual", (0, 0, 0), ("absent", "no_split_rows")), ("annual", (50, 0, 50), ("insufficient", "n<100")),
    ("annual", (120, 0, 120), ("insufficient", "single_class")), ("annual", (120, 5, 115), ("insufficient", "min_class<20")),
    ("contract", (50, 0, 50), ("insufficient", "single_class")), ("contract", (0, 0, 0), ("insufficient", "no_samples")),
    ("contract", (80, 30, 50), ("insufficient", "n<100")),
]


@pytest.mark.parametrize("mode, counts, want", SUPPORT)
def test_support_vocabularies(spark, mode, counts, want):
    status, reason = C.support_status(mode, *[F.lit(c) for c in counts])
    assert tuple(spark.range(1).select(status, reason).first()) == want


def test_first_record_per_cluster(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, None, 1), (4, "b", 9)], "sample_id long, cluster_id string, row_order int")
    assert ids(C.first_per_cluster(df, ["row_order", "sample_id"])) == [2, 4]


def test_episode_first(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, None, True), (4, "b", None)], "sample_id long, cluster_id string, episode_first boolean")
    assert ids(C.episode_first(df)) == [1]


def test_one_record_protocol_purges_before_taking_the_first(spark):
    train = spark.createDataFrame([("t", 1, "a", 1, 0), ("t", 2, "a", 2, 1), ("t", 3, "b", 3, 1)], "task string, sample_id long, cluster_id string, o int, y int")
    test = spark.createDataFrame([("t", 4, "a", 4, 0), ("t", 5, "c", 6, 1), ("t", 6, "c", 5, 0), ("t", 7, None, 7, 0)], train.schema)
    tr, te, audit = C.one_record_per_cluster(train, test, ["task"], ["o", "sample_id"])
    assert ids(tr) == [1, 3] and ids(te) == [6]
    r = audit.first()
    assert (r.train_input_n, r.train_n, r.evaluation_input_n, r.removed_seen_n, r.evaluation_n) == (3, 2, 4, 2, 1)


def test_month_folds_against_a_loop(spark):
    rng = random.Random(3)
    rows = [("t", i, date(2020, 1, 1) + timedelta(days=rng.randrange(300)), rng.randrange(2)) for i in range(600)]
    df = spark.createDataFrame(rows, "task string, sample_id long, d date, y int")
    months = sorted({(r[2].year, r[2].month) for r in rows})
    n = len(months)
    cuts = sorted({max(2, int(n * f)) for f in (0.50, 0.67, 0.84)} | {n})
    want = []
    for lo, hi in zip(cuts, cuts[1:]):
        train = [r for r in rows if (r[2].year, r[2].month) in months[:lo]]
        valid = [r for r in rows if (r[2].year, r[2].month) in months[lo:hi]]
        want.append((len(train), len(valid), "train_through=%d-%02d;validation=%d-%02d..%d-%02d" % (*months[lo - 1], *months[lo], *months[hi - 1])))
    got = [(r.n_train, r.n_validation, r.fold_note) for r in C.month_fold_audit(df).orderBy("border_index").collect()]
    assert got == want
    assert C.month_fold_rows(df).count() == sum(a + b for a, b, _ in want)


def test_three_months_give_no_fold(spark):
    df = spark.createDataFrame([("t", i, date(2020, 1 + i % 3, 1), i % 2) for i in range(300)], "task string, sample_id long, d date, y int")
    assert C.month_fold_audit(df).count() == 0


def test_year_folds_audit_every_year_and_purge(spark):
    rows = [("t", i, f"c{i}", 2020 + i % 3, i % 2) for i in range(90)] + [("t", 1000, "c0", 2021, 1), ("t", 1001, None, 2021, 1), ("t", 1002, "", 2022, 0)]
    df = spark.createDataFrame(rows, "task string, sample_id long, cluster_id string, year int, y int")
    audit = C.year_fold_audit(df).orderBy("validation_year").collect()
    assert [r.validation_year for r in audit] == [2021, 2022]
    assert (audit[0].removed_overlap_n, audit[0].removed_missing_cluster_n) == (1, 1)
    assert all(r.status == "adequate" for r in audit)
    table = C.year_fold_rows(df, C.year_fold_audit(df))
    train = table.where("split = 'train'").select("fold_index", "cluster_id")
    valid = table.where("split = 'validation'")
    assert valid.join(train, ["fold_index", "cluster_id"], "left_semi").count() == 0
    assert valid.where("fold_index = 2021").count() == audit[0].n_validation


def test_history_is_added_once_and_validation_purged(spark):
    rows = [("t", i, f"c{i}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "task string, sample_id long, cluster_id string, y int")
    folds = df.select("task", "sample_id", F.lit(0).alias("fold_index"), F.when(F.col("sample_id") < 40, "train").otherwise("validation").alias("split"))
    history = df.where("sample_id < 10").unionByName(spark.createDataFrame([("t", 900, "c50", 1)], df.schema))
    table, audit = C.fold_table_with_history(df.unionByName(spark.createDataFrame([("t", 900, "c50", 1)], df.schema)), folds, history)
    r = audit.first()
    assert (r.n_train, r.removed_overlap_n, r.n_validation, r.status) == (41, 1, 19, "adequate")
    assert table.where("split = 'train'").count() == 41


def test_group_attachment(spark):
    df = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t")], "sample_id long, task string")
    groups = spark.createDataFrame([(1, "t", "g1", "e"), (1, "u", "gx", "e"), (2, None, "g2", "e")], "sample_id long, task string, cluster_id string, episode_id string")
    got = {r.sample_id: r.cluster_id for r in C.attach_groups(df, groups).collect()}
    assert got == {1: "g1", 2: "g2", 3: None}
    assert C.attach_groups(df, None).where("cluster_id is null").count() == 3
    twice = groups.unionByName(spark.createDataFrame([(1, "", "g9", "e")], groups.schema))
    with pytest.raises(Exception, match="duplicate grouping rows"):
        C.attach_groups(df, twice).collect()


def test_dates(spark):
    df = spark.createDataFrame([("a", "2020-01-05 10:00:00", " p "), ("b", "2020-02-01", "q")], "sample_id string, accept_datetime string, cluster_id string")
    rows = C.normalize_dates(df).orderBy("sample_id").collect()
    assert [r.target_date for r in rows] == [date(2020, 1, 5), date(2020, 2, 1)] and rows[0].cluster_id == "p"
    assert C.attach_dates(df.select("sample_id", "cluster_id"), C.normalize_dates(df)).columns.count("cluster_id") == 1
    assert C.filter_dates(C.normalize_dates(df), date(2020, 1, 5), date(2020, 1, 31), "target_date").count() == 1
    with pytest.raises(ValueError):
        C.filter_dates(df, date(2020, 2, 1), date(2020, 1, 1))
    with pytest.raises(Exception, match="unparseable"):
        C.normalize_dates(df.withColumn("accept_datetime", F.lit("soon"))).collect()


def test_ordinal_with_one_hot_day(spark):
    rng = random.Random(5)
    rows = [("t", i * 7, date(2020, 1, 1) if i % 3 else date(2020, 1, 2 + i % 20)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "task string, sample_id long, d date")
    got = {r.sample_id: r.row_order for r in row_ordinal(df, ["task"], "d", "sample_id").collect()}
    want = {s: i for i, (_, s, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))}
    assert got == want


def test_digests_depend_on_members_only(spark):
    df = spark.createDataFrame([("g", i, f"c{i}") for i in range(500)], "g string, i long, c string")
    one = tree_digest(df, ["g"], row_text(["i", "c"])).first()
    assert one.n == 500 and one == tree_digest(df.orderBy(F.col("i").desc()).repartition(7), ["g"], row_text(["i", "c"])).first()
    assert one.tree_sha256 != tree_digest(df.where("i <> 3"), ["g"], row_text(["i", "c"])).first().tree_sha256


def test_membership_digest_depends_on_order(spark):
    rows = [("g", i, f"c{i}", date(2020, 1, 1 + i % 9)) for i in range(300)]
    schema = "g string, i long, c string, d date"
    digest = lambda r: membership_digest(spark.createDataFrame(r, schema), ["g"], ["i", "c"], "d", "i").first()
    moved = [(g, i, c, date(2020, 2, 1) if i == 7 else d) for g, i, c, d in rows]
    assert digest(rows) == digest(rows[::-1]) and digest(rows).tree_sha256 != digest(moved).tree_sha256
    folds = spark.createDataFrame([("g", f, s, i) for f in range(2) for i, s in ((1, "train"), (2, "validation"))], "g string, fold_index int, split string, sample_id long")
    other = folds.withColumn("split", F.when((F.col("sample_id") == 2) & (F.col("fold_index") == 1), "train").otherwise(F.col("split")))
    assert fold_digest(folds, ["g"]).first() != fold_digest(other, ["g"]).first()


def test_protocol_dates_in_order():
    with pytest.raises(ValueError, match="not in order"):
        C.ProtocolDates(current_start=date(2020, 1, 1))


def test_repeated_dates_and_groups_fail(spark):
    dates = spark.createDataFrame([("a", "2020-01-05"), ("a", "2020-01-06")], "sample_id string, collection_date string")
    for bad in (dates, spark.createDataFrame([(None, "2020-01-05")], dates.schema), spark.createDataFrame([(" ", "2020-01-05")], dates.schema)):
        with pytest.raises(Exception, match="missing or repeated sample"):
            C.normalize_dates(bad).collect()
    groups = spark.createDataFrame([(1, "t", "g1", "e"), (1, "t", "g2", "e")], "sample_id long, task string, cluster_id string, episode_id string")
    with pytest.raises(Exception, match="repeated grouping rows"):
        C.attach_groups(spark.createDataFrame([(1, "t")], "sample_id long, task string"), groups).collect()
