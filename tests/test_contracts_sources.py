import pytest
from pyspark.sql import functions as F

from cohortlane.operators import compare as R
from cohortlane.operators import contracts as K
from cohortlane.sized import checked_broadcast
from cohortlane.sources import artifacts as A
from cohortlane.sources import tables as T


def status(checks):
    return {r.check_name: (r.violations, r.examples) for r in checks.collect()}


def test_missing_columns_are_all_named(spark):
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        K.require_columns(spark.range(1), ["id", "c", "b"], "x")


def test_private_columns(spark):
    assert K.private_columns(spark.range(1).select(F.col("id").alias("Sample_PRIVATE_note"), F.lit(1).alias("ok"))) == ["Sample_PRIVATE_note"]


def test_duplicates_and_require(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    check = K.duplicate_keys(df, ["k"], "key")
    assert status(check) == {"key": (2, "1")}
    with pytest.raises(ValueError, match="key: n=2"):
        K.require(check)
    K.require(K.duplicate_keys(df.distinct(), ["k"], "key"))


def test_rows_where_counts_unknown_as_violation(spark):
    df = spark.createDataFrame([(1, "S"), (2, None), (3, "X")], "i int, sir string")
    assert status(K.rows_where(df, ~F.col("sir").isin("S"), "i", "v"))["v"] == (2, "2,3")


def test_contiguous(spark):
    good = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "g string, r int")
    assert status(K.row_numbers_contiguous(good, "r", "g", "n"))["n"][0] == 0
    assert status(K.row_numbers_contiguous(good.where("r <> 0 or g <> 'a'"), "r", "g", "n"))["n"] == (1, "a")


def test_scan(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (float("nan"),)], "v double")
    r = K.binary_scan(df, ["v"]).first()
    assert (r.nonfinite_n, r.nonbinary_n, r.status) == (1, 2, "FAIL")


def folds(spark, rows):
    return spark.createDataFrame(rows, "task string, fold_index int, split string, sample_id long, y int")


def test_development_contract_finds_each_leak(spark):
    dev = spark.createDataFrame([("t", i, i % 2) for i in range(8)], "task string, sample_id long, y int")
    good = [("t", f, "train" if i < 4 else "validation", i, i % 2) for f in (0,) for i in range(6)] + [("t", 1, "train", i, i % 2) for i in range(6)] + [
        ("t", 1, "validation", i, i % 2) for i in (6, 7)]
    test = spark.createDataFrame([("t", 100, 1)], "task string, sample_id long, y int")
    assert all(v == 0 for v, _ in status(K.development_contract(dev, folds(spark, good), test)).values())
    leaks = {
        "fold_inside_development": [("t", 0, "train", 77, 0)], "train_validation_disjoint": [("t", 0, "validation", 0, 0)],
        "validation_once": [("t", 0, "validation", 6, 0)], "fold_split_value": [("t", 0, "test", 3, 1)],
    }
    for name, extra in leaks.items():
        assert status(K.development_contract(dev, folds(spark, good + extra), test))[name][0] > 0, name
    overlap = spark.createDataFrame([("t", 3, 1)], "task string, sample_id long, y int")
    found = status(K.development_contract(dev, folds(spark, good), overlap))
    assert found["development_evaluation_disjoint"] == (1, "t|3") and found["fold_evaluation_disjoint"][0] == 1
    one = status(K.development_contract(dev, folds(spark, [r for r in good if r[1] == 0]), test))
    assert one["at_least_two_folds"] == (1, "t")


def test_checked_broadcast(spark):
    small = checked_broadcast(spark.range(5), 10)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    large = spark.range(50)
    assert checked_broadcast(large, 10) is large


def test_regression_statuses(spark):
    schema = "k string, n long, m double, t string"
    a = spark.createDataFrame([("x", 1, 0.5, "u"), ("y", 2, None, "u"), ("z", 3, 0.1, None)], schema)
    b = spark.createDataFrame([("x", 1, 0.5 + 1e-12, "u"), ("y", 3, None, "v"), ("w", 3, 0.1, None)], schema)
    out = R.tolerance_regression(a, b, ["k"], metrics=["m"], counts=["n"], texts=["t"], corrected=(F.col("k") == "y") & (F.col("field") == "n"))
    got = {(r.k, r.field): r.status for r in out.collect()}
    assert got[("x", "n")] == got[("x", "m")] == got[("x", "t")] == got[("y", "m")] == "PASS"
    assert got[("y", "n")] == "CORRECTED_FROZEN_METADATA" and got[("y", "t")] == "FAIL"
    assert got[("z", "n")] == got[("w", "m")] == "FAIL"
    total = R.regression_status(out).first()
    assert total.status == "FAIL" and total.corrected_n == 1


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    T.write_new(df, f"{tmp_path}/x.parquet")
    assert T.read_table(spark, f"{tmp_path}/x.parquet").count() == 2
    with pytest.raises(Exception, match="exist"):
        T.write_new(df, f"{tmp_path}/x.parquet")
    (tmp_path / "a.tsv").write_text("i\ts\n1\tx\n")
    (tmp_path / "a.csv").write_text("i,s\n1,x\n2,y\n")
    assert T.read_table(spark, f"{tmp_path}/a.tsv", "i int, s string").first().s == "x"
    assert T.read_table(spark, f"{tmp_path}/a.csv", "i int, s string").count() == 2
    with pytest.raises(ValueError):
        T.read_table(spark, f"{tmp_path}/a.xlsx")
    T.write_predictions(df, None)


def test_peak_files(spark, tmp_path):
    (tmp_path / "s1.tsv").write_text("mz\tintensity\n2000.5\t3\n2100\t4\n")
    (tmp_path / "s2.tsv").write_text("mz\tintensity\n2500\t1\n")
    peaks = T.read_peak_tables(spark, str(tmp_path))
    assert {r.spectrum_id: r["count"] for r in peaks.groupBy("spectrum_id").count().collect()} == {"s1": 2, "s2": 1}
    metadata = spark.createDataFrame([("s1",), ("s3",)], "spectrum_id string")
    assert [r.spectrum_id for r in T.missing_spectra(metadata, peaks).collect()] == ["s3"]
    (tmp_path / "s4.tsv").write_text("mz\tintensity\nabc\t1\n")
    with pytest.raises(Exception):  # noqa: B017
        T.read_peak_tables(spark, str(tmp_path)).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_text("x" * 100)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.txt").write_text("other")
    assert {r.relative_path for r in A.artifact_manifest(spark, f"file://{tmp_path}/", "*.txt").where("sha256 is not null").collect()} == {"a.txt", "b.txt", "deep/a.txt"}
    files = A.artifact_manifest(spark, str(tmp_path), "*.txt", size_limit=50)
    got = {r.relative_path: r for r in files.collect()}
    assert got["a.txt"].sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824" and got["b.txt"].hash_status == "skipped_size"
    same = files.select("relative_path", "sha256").where("sha256 is not null")
    assert A.verify_manifest(files, same).first().status == "PASS"
    wrong = spark.createDataFrame([("a.txt", "0"), ("c.txt", "1")], "relative_path string, sha256 string")
    r = A.verify_manifest(files, wrong).first()
    assert (r.files_n, r.missing_n, r.mismatch_n, r.status) == (2, 1, 1, "FAIL")
    for bad in (wrong.where("false"), wrong.unionByName(wrong)):
        with pytest.raises(Exception, match="manifest is empty or lists a path twice"):
            A.verify_manifest(files, bad).collect()
    findings = A.forbidden_files(spark.createDataFrame([("x/Model.PKL", 10), ("y.md", 99)], "relative_path string, bytes long"), 50)
    assert {(r.relative_path, r.finding) for r in findings.collect()} == {("x/Model.PKL", "forbidden_suffix"), ("y.md", "size_limit")}


def test_private_patterns(spark):
    texts = ["see /home/ann/x and /home/bob/y", "host 10.1.2.3 or 192.168.0.7, not 11.1.2.3", r"C:\data\x", "/Users/ann/z", "clean"]
    rows = A.pattern_audit(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t")
    assert {(r.i, r.pattern): r.match_n for r in rows.collect()} == {
        (0, "linux_absolute_home"): 2, (1, "private_ipv4"): 2, (2, "windows_absolute_path"): 1, (3, "mac_absolute_home"): 1}


def test_large_files_are_hashed_piece_by_piece(spark, tmp_path, monkeypatch):
    import hashlib

    from cohortlane.sources import artifacts

    data = {"small.bin": b"abc", "large one.bin": bytes(range(256)) * 5000}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(artifacts, "WHOLE", 1000)
    found = {r.relative_path: (r.bytes, r.sha256, r.hash_status) for r in artifacts.artifact_manifest(spark, str(tmp_path)).collect()}
    assert found == {n: (len(c), hashlib.sha256(c).hexdigest(), "hashed") for n, c in data.items()}
