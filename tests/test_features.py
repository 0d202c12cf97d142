import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlane.operators import features as S

PEAKS = "spectrum_id string, mz double, intensity double"


def bin_by_loop(mz, intensity):
    out = np.zeros(6000)
    for m, v in zip(mz, intensity, strict=True):
        if 2000 <= m < 20000:
            i = int(np.floor((m - 2000) / 3))
            out[i] = max(out[i], v)
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


@pytest.fixture(scope="module")
def random_peaks():
    rng = np.random.default_rng(2)
    return [(f"s{i % 12}", float(rng.uniform(1900, 20100)), float(rng.integers(0, 50))) for i in range(3000)]


def dense(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], np.zeros(6000))[r["bin"]] = r["value"]
    return out


def test_small_spectrum(spark):
    rows = [("a", m, v) for m, v in zip([1999, 2000.1, 2001, 2003, 19999.9, 20000], [99.0, 4, 9, 16, 25, 99], strict=True)]
    got = {r.bin: r.value for r in S.bin_spectra(spark.createDataFrame([(a, float(b), float(c)) for a, b, c in rows], PEAKS)).collect()}
    assert sorted(got) == [0, 1, 5999] and got[1] > got[0] and sum(v * v for v in got.values()) == pytest.approx(1)


def test_binning_against_a_loop(spark, random_peaks):
    got = dense(S.bin_spectra(spark.createDataFrame(random_peaks, PEAKS)).collect(), "spectrum_id")
    for s, vector in got.items():
        mine = [(m, v) for t, m, v in random_peaks if t == s]
        assert np.abs(vector - bin_by_loop(*zip(*mine, strict=True))).max() < 1e-15


@pytest.mark.parametrize("bad", [(2100.0, -1.0), (2100.0, float("nan")), (float("inf"), 1.0), (2100.0, None)])
def test_bad_peaks_fail(spark, bad):
    with pytest.raises(Exception, match="non-finite or negative"):
        S.bin_spectra(spark.createDataFrame([("a", *bad)], PEAKS)).collect()


def test_replicates_count_empty_spectra(spark):
    features = spark.createDataFrame([("r1", 0, 1.0), ("r2", 1, 1.0), ("r3", 5, 1.0)], "spectrum_id string, bin int, value double")
    spectra = spark.createDataFrame([("r1", "x"), ("r2", "x"), ("r3", "z"), ("r4", "z")], "spectrum_id string, sample_id string")
    got = {(r.sample_id, r.bin): r.value for r in S.replicate_mean(features, spectra).collect()}
    assert got == pytest.approx({("x", 0): 2 ** -0.5, ("x", 1): 2 ** -0.5, ("z", 5): 1.0})


def test_replicate_mean_against_numpy(spark, random_peaks):
    peaks = spark.createDataFrame(random_peaks, PEAKS)
    spectra = spark.createDataFrame([(f"s{i}", f"x{i % 3}") for i in range(13)], "spectrum_id string, sample_id string")
    features = S.bin_spectra(peaks)
    by_spectrum = dense(features.collect(), "spectrum_id")
    got = dense(S.replicate_mean(features, spectra).collect(), "sample_id")
    for k in range(3):
        stack = np.array([by_spectrum.get(f"s{i}", np.zeros(6000)) for i in range(13) if i % 3 == k])
        mean = stack.mean(axis=0)
        assert np.abs(got[f"x{k}"] - mean / np.linalg.norm(mean)).max() < 1e-14


def test_all_zero_spectrum_stays_zero(spark):
    out = S.bin_spectra(spark.createDataFrame([("a", 2100.0, 0.0)], PEAKS))
    assert out.first().value == 0.0 and S.presence(out, "spectrum_id").count() == 0


def profile(n=1500):
    mz = np.linspace(2000, 2300, n)
    return mz, 0.3 * np.sin(mz / 80) + 20 * np.exp(-0.5 * ((mz - 2100) / 0.8) ** 2) + 1.0


def test_profile_peak(spark):
    mz, y = profile()
    points = spark.createDataFrame([("p", float(a), float(b)) for a, b in zip(mz, y, strict=True)], PEAKS)
    got = S.profile_presence(points).collect()
    assert 33 in [r.bin for r in got] and len(got) <= 3
    variants = S.profile_presence(points.repartition(5), S.PROFILE_VARIANTS)
    assert variants.select("variant").distinct().count() == len(S.PROFILE_VARIANTS)


@pytest.mark.parametrize("points", [[(2000.0 + i, 1.0) for i in range(10)], [(2000.0, 1.0)] * 20, [(2000.0 + i, float("nan")) for i in range(20)]])
def test_bad_profiles_fail(spark, points):
    with pytest.raises(Exception):  # noqa: B017
        S.profile_presence(spark.createDataFrame([("p", a, b) for a, b in points], PEAKS)).collect()


def test_profile_settings_are_checked():
    for bad in (S.ProfileSettings(window=14), S.ProfileSettings(polynomial=15), S.ProfileSettings(baseline_sigma=0), S.ProfileSettings(distance=0)):
        with pytest.raises(ValueError):
            bad.check()


def test_smoothing_keeps_a_cubic():
    x = np.arange(40.0)
    y = 0.01 * x**3 - x**2 + 3
    assert np.abs(S._smooth(y, 15, 3) - y).max() < 1e-9


def test_baseline_of_a_constant_is_the_constant():
    assert np.abs(S._baseline(np.full(300, 2.5), 40.0) - 2.5).max() < 1e-12


def test_maxima_and_plateaus():
    y = np.array([0, 1, 0, 2, 2, 2, 0, 3, 3, 1, 5.0])
    assert list(S._local_maxima(y)) == [1, 4, 7]


def test_spacing_goes_from_the_highest_down():
    y = np.zeros(20)
    y[[3, 6, 9]] = [1, 2, 1.5]
    assert list(S._spaced(y, np.array([3, 6, 9]), 5)) == [6]
    assert list(S._spaced(y, np.array([3, 6, 9]), 3)) == [3, 6, 9]


def prominence_by_walk(y, p):
    sides = []
    for step in (-1, 1):
        i, low = p, y[p]
        while 0 <= i < len(y) and y[i] <= y[p]:
            low = min(low, y[i])
            i += step
        sides.append(low)
    return y[p] - max(sides)


def test_prominence_against_a_walk():
    y = np.random.default_rng(0).normal(size=300).cumsum()
    for p in S._local_maxima(y):
        assert S._prominence(y, p) == pytest.approx(prominence_by_walk(y, p))


def test_overlap_and_summary(spark):
    schema = "variant string, s string, bin int"
    observed = spark.createDataFrame([("v", "a", 1), ("v", "a", 2), ("v", "b", 7)], schema)
    frozen = spark.createDataFrame([("a", 2), ("a", 3), ("b", 7)], "s string, bin int")
    rows = spark.createDataFrame([("v", "a"), ("v", "b"), ("v", "c")], "variant string, s string")
    overlap = S.presence_overlap(observed, frozen, rows, "s")
    assert {r.s: r.jaccard for r in overlap.collect()} == pytest.approx({"a": 1 / 3, "b": 1.0, "c": 1.0})
    r = S.presence_summary(overlap).first()
    assert (r.row_n, r.rows_different_n, r.detected_median, r.jaccard_median) == (3, 1, 1.0, 1.0)


def test_equivalence_treats_absent_bins_as_zero(spark):
    a = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 1.0)], "s string, bin int, value double")
    b = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1e-8), ("b", 2, 1.0)], "s string, bin int, value double")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    r = S.equivalence_summary(S.feature_equivalence(a, b, rows, "s")).first()
    assert (r.row_n, r.pass_n, r.fail_n, r.zero_row_n, r.max_abs_difference) == (3, 2, 1, 1, 1.0)


def test_semantics_dispatch(spark):
    mz, y = profile()
    rows = [("d", float(a), float(b)) for a, b in zip(mz, y, strict=True)] + [("l", 2500.0, 3.0), ("l", 2600.0, 0.0)]
    spectra = spark.createDataFrame([("d", S.DENSE_PROFILE), ("l", S.PEAK_LIST)], "spectrum_id string, source_semantics string")
    got = S.presence_by_semantics(spark.createDataFrame(rows, PEAKS), spectra)
    assert [r.bin for r in got.where("spectrum_id = 'l'").collect()] == [166]
    other = spectra.withColumn("source_semantics", F.lit("other"))
    with pytest.raises(Exception, match="unsupported source semantics"):
        S.presence_by_semantics(spark.createDataFrame(rows, PEAKS), other).collect()


def test_vectors(spark):
    f = spark.createDataFrame([("a", 1, 0.5), ("a", 3, 2.0)], "s string, bin int, value double")
    assert S.dense_vectors(f, "s", 4).first()["values"] == [0.0, 0.5, 0.0, 2.0]
