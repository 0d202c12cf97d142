"""Spectra to features: binning, replicate means, presence, dense-profile peaks, equivalence checks.

The canonical form is the long sparse table ``(id, bin, value)``; a bin without a row is zero.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.functions.columns import count_true, ratio
from cohortlane.operators.ranked import exact_quantiles

# The functions that run in Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class BinAxis:
    """Fixed-width bins over [low, high)."""

    low: float = 2000.0
    high: float = 20000.0
    width: float = 3.0

    @property
    def n_bins(self) -> int:
        return int(round((self.high - self.low) / self.width))

    def covers(self, mz: Column) -> Column:
        return (mz >= self.low) & (mz < self.high)

    def bin(self, mz: Column) -> Column:
        return F.floor((mz - F.lit(self.low)) / F.lit(self.width)).cast("int")


@dataclass(frozen=True)
class ProfileSettings:
    """Peak extraction settings for dense profiles."""

    window: int = 15
    polynomial: int = 3
    baseline_sigma: float = 150.0
    noise_multiple: float = 3.0
    distance: int = 5

    def check(self) -> ProfileSettings:
        if self.window < 3 or self.window % 2 == 0:
            raise ValueError("smoothing window must be odd and at least 3")
        if not 0 <= self.polynomial < self.window:
            raise ValueError("polynomial order must be below the smoothing window")
        if self.baseline_sigma <= 0 or self.noise_multiple <= 0 or self.distance < 1:
            raise ValueError("baseline sigma, noise multiple and distance must be positive")
        return self


# The named extraction variants of the sensitivity analysis.
PROFILE_VARIANTS = {
    "public_rebuild_default": ProfileSettings(),
    "baseline_sigma_100": ProfileSettings(baseline_sigma=100.0),
    "baseline_sigma_200": ProfileSettings(baseline_sigma=200.0),
    "prominence_2p5": ProfileSettings(noise_multiple=2.5),
    "prominence_4p0": ProfileSettings(noise_multiple=4.0),
    "distance_3": ProfileSettings(distance=3),
    "distance_7": ProfileSettings(distance=7),
}
EQUIVALENCE_TOLERANCE = 5e-7
PEAK_LIST, DENSE_PROFILE = "mzml_export_peak_list_like", "converted_dense_profile_txt"


def l2_normalized(df: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Divide by the L2 norm per key. A key has at most one row per bin, so the window stays small.

    Keys whose values are all zero stay zero; a norm that is not finite fails the job.
    """
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(*key)))
    bad = F.isnan("_norm") | (F.col("_norm") == float("inf"))
    out = df.withColumn("_norm", norm)
    scaled = (
        F.when(bad, F.raise_error(F.lit("feature vector contains non-finite values")).cast("double"))
        .when(F.col("_norm") == 0, F.col(value)).otherwise(F.col(value) / F.col("_norm"))
    )
    return out.withColumn(value, scaled).drop("_norm")


def bin_spectra(peaks: DataFrame, axis: BinAxis = BinAxis(), *, spectrum: str = "spectrum_id") -> DataFrame:
    """Peaks ``(spectrum, mz, intensity)`` to ``(spectrum, bin, value)``: highest intensity per bin, square root, L2.

    The maximum combines on the map side, so a spectrum with any number of peaks shuffles at most
    one row per bin and task. Values that are not finite or negative fail the job.
    """
    mz, intensity = F.col("mz").cast("double"), F.col("intensity").cast("double")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    valid = F.coalesce(finite(mz) & finite(intensity) & (intensity >= 0), F.lit(False))
    # The check is part of the m/z value, so the axis filter below cannot drop a bad row unseen.
    checked = F.when(valid, mz).otherwise(F.raise_error(F.lit("non-finite or negative peak value")).cast("double"))
    highest = (
        peaks.select(spectrum, checked.alias("mz"), intensity.alias("intensity"))
        .where(axis.covers(F.col("mz")))
        .groupBy(spectrum, axis.bin(F.col("mz")).alias("bin"))
        .agg(F.max("intensity").alias("intensity"))
    )
    return l2_normalized(highest.select(spectrum, "bin", F.sqrt("intensity").alias("value")), [spectrum])


def replicate_mean(features: DataFrame, spectra: DataFrame, *, spectrum: str = "spectrum_id", sample: str = "sample_id") -> DataFrame:
    """Mean over all spectra of a sample (an absent bin counts zero), then L2.

    ``spectra`` lists every (spectrum, sample), also spectra without a peak on the axis: the
    divisor is their number. It must hold each spectrum once.
    """
    totals = spectra.groupBy(sample).agg(F.count(F.lit(1)).alias("_n"))
    summed = (
        features.join(spectra.select(spectrum, sample), spectrum).groupBy(sample, "bin").agg(F.sum("value").alias("value"))
    )
    mean = summed.join(totals, sample).select(sample, "bin", (F.col("value") / F.col("_n")).alias("value"))
    return l2_normalized(mean, [sample])


def presence(features: DataFrame, key: str) -> DataFrame:
    """Bins with a value above zero."""
    return features.where(F.col("value") > 0).select(key, "bin")


def sample_presence(features: DataFrame, spectra: DataFrame, *, spectrum: str = "spectrum_id", sample: str = "sample_id") -> DataFrame:
    """A bin is present in a sample if it is in any of its spectra."""
    return presence(features, spectrum).join(spectra.select(spectrum, sample), spectrum).select(sample, "bin").distinct()


def spectra_per_sample(spectra: DataFrame, *, sample: str = "sample_id", keys: Sequence[str] = ()) -> DataFrame:
    """Lowest, median and highest number of spectra per sample. The counts take few distinct values."""
    per_sample = spectra.groupBy(*keys, sample).agg(F.count(F.lit(1)).alias("n"))
    return per_sample.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_n"), F.sum("n").alias("spectrum_n"), F.min("n").alias("min_spectra"),
        F.median("n").alias("median_spectra"), F.max("n").alias("max_spectra"),
    )


def presence_by_semantics(peaks: DataFrame, spectra: DataFrame, axis: BinAxis = BinAxis()) -> DataFrame:
    """Presence bins per spectrum by source semantics: peak lists by non-empty bins, dense profiles by peak
    extraction; any other semantics fails the job."""
    tagged = peaks.join(spectra.select("spectrum_id", "source_semantics"), "spectrum_id")
    known = F.when(F.col("source_semantics").isin(PEAK_LIST, DENSE_PROFILE), F.col("source_semantics")).otherwise(
        F.raise_error(F.concat(F.lit("unsupported source semantics: "), F.col("source_semantics"))).cast("string")
    )
    tagged = tagged.withColumn("source_semantics", known)
    listed = presence(bin_spectra(tagged.where(F.col("source_semantics") == PEAK_LIST), axis), "spectrum_id")
    dense = profile_presence(tagged.where(F.col("source_semantics") == DENSE_PROFILE), axis=axis).select("spectrum_id", "bin")
    return listed.unionByName(dense)


# --- dense profiles ----------------------------------------------------------------------------

def _smooth(y: np.ndarray, window: int, order: int) -> np.ndarray:
    """Local polynomial smoothing; the ends use the polynomial of the first and last full window."""
    half = window // 2
    offsets = np.arange(-half, half + 1)
    projector = np.linalg.pinv(np.vander(offsets, order + 1, increasing=True))
    out = np.convolve(y, projector[0][::-1], mode="same")
    powers = np.vander(offsets, order + 1, increasing=True)
    out[:half] = (powers @ (projector @ y[:window]))[:half]
    out[-half:] = (powers @ (projector @ y[-window:]))[-half:]
    return out


def _baseline(y: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian average truncated at four sigma, ends continued by their value."""
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(y, radius, mode="edge"), weights / weights.sum(), mode="valid")


def _local_maxima(y: np.ndarray) -> np.ndarray:
    """Indices of strict maxima; a flat top counts once, at its middle; the ends never count."""
    starts = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    stops = np.r_[starts[1:], y.size] - 1
    level = y[starts]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (starts[inner] + stops[inner]) // 2


def _spaced(y: np.ndarray, peaks: np.ndarray, distance: int) -> np.ndarray:
    """From the highest peak down, drop peaks closer than ``distance`` points to a kept one."""
    keep = np.ones(peaks.size, dtype=bool)
    for i in np.argsort(y[peaks], kind="stable")[::-1]:
        if keep[i]:
            low, high = np.searchsorted(peaks, [peaks[i] - distance + 1, peaks[i] + distance])
            keep[low:high] = False
            keep[i] = True
    return peaks[keep]


def _prominence(y: np.ndarray, peak: int) -> float:
    """Height above the higher of the two lowest points before a larger value on either side."""
    higher_left, higher_right = np.flatnonzero(y[:peak] > y[peak]), np.flatnonzero(y[peak + 1:] > y[peak])
    left = higher_left[-1] + 1 if higher_left.size else 0
    right = peak + 1 + higher_right[0] if higher_right.size else y.size
    return float(y[peak] - max(y[left:peak + 1].min(), y[peak:right].min()))


def profile_peaks(mz: np.ndarray, intensity: np.ndarray, variants: dict[str, ProfileSettings]) -> Iterator[tuple[str, np.ndarray]]:
    """Peak positions of one profile for each variant; smoothing and baseline are shared where equal."""
    smooth: dict[tuple[int, int], np.ndarray] = {}
    residuals: dict[tuple[int, int, float], tuple[np.ndarray, np.ndarray, float]] = {}
    prominences: dict[tuple[int, int, float], dict[int, float]] = {}
    for name, s in variants.items():
        if mz.size < s.window:
            raise ValueError("dense profile is shorter than the smoothing window")
        key = (s.window, s.polynomial, s.baseline_sigma)
        if key not in residuals:
            if key[:2] not in smooth:
                smooth[key[:2]] = _smooth(intensity, s.window, s.polynomial)
            residual = smooth[key[:2]] - _baseline(smooth[key[:2]], s.baseline_sigma)
            noise = 1.4826 * float(np.median(np.abs(residual - np.median(residual))))
            residuals[key] = (residual, _local_maxima(residual), noise if np.isfinite(noise) and noise > 0 else 1.0)
            prominences[key] = {}
        residual, maxima, noise = residuals[key]
        known = prominences[key]
        kept = []
        for p in _spaced(residual, maxima, s.distance):
            if p not in known:
                known[p] = _prominence(residual, p)
            if known[p] >= s.noise_multiple * noise:
                kept.append(p)
        yield name, mz[kept]


def profile_presence(
    points: DataFrame, variants: dict[str, ProfileSettings] | None = None, axis: BinAxis = BinAxis(), *, spectrum: str = "spectrum_id"
) -> DataFrame:
    """Presence bins ``(variant, spectrum, bin)`` of dense profiles, one grouped Arrow call per profile.

    A profile is one spectrum on the instrument's axis, so its length is fixed by the instrument and
    does not grow with the data; only the number of profiles does. Baseline, noise level, peak
    spacing and prominence need the whole profile, hence the grouped call.
    """
    settings = {n: s.check() for n, s in (variants or {"public_rebuild_default": ProfileSettings()}).items()}
    id_type = points.schema[spectrum].dataType.simpleString()

    def extract(profile: pd.DataFrame) -> pd.DataFrame:
        profile = profile.sort_values("mz")
        mz, intensity = profile["mz"].to_numpy(float), profile["intensity"].to_numpy(float)
        if not (np.isfinite(mz).all() and np.isfinite(intensity).all()):
            raise ValueError("dense profile contains non-finite values")
        if not (np.diff(mz) > 0).all():
            raise ValueError("dense-profile m/z values must be strictly increasing")
        parts = []
        for name, where in profile_peaks(mz, intensity, settings):
            inside = where[(where >= axis.low) & (where < axis.high)]
            bins = np.unique(np.floor((inside - axis.low) / axis.width).astype("int32"))
            parts.append(pd.DataFrame({"variant": name, spectrum: profile[spectrum].iloc[0], "bin": bins}))
        return pd.concat(parts, ignore_index=True)

    return points.select(spectrum, F.col("mz").cast("double"), F.col("intensity").cast("double")).groupBy(spectrum).applyInPandas(
        extract, f"variant string, {spectrum} {id_type}, bin int"
    )


# --- checks ------------------------------------------------------------------------------------

def presence_overlap(observed: DataFrame, frozen: DataFrame, rows: DataFrame, key: str, variant: str = "variant") -> DataFrame:
    """Per (variant, row): bins on either side, shared bins and Jaccard index (1 for two empty rows).

    ``rows`` lists every (variant, row), so rows without a bin take part.
    """
    # a row has at most one entry per bin of the axis and variant; all three tables meet by the key alone
    listed = rows.groupBy(key).agg(F.collect_list(variant).alias("_variants"))
    seen = observed.groupBy(key).agg(F.collect_set(F.struct(F.col(variant).alias("v"), F.col("bin").alias("b"))).alias("_seen"))
    fixed = frozen.groupBy(key).agg(F.collect_set("bin").alias("_fixed"))
    met = listed.join(fixed, key, "left").join(seen, key, "left").select(key, F.explode("_variants").alias(variant), "_seen", "_fixed")
    own = F.transform(F.filter("_seen", lambda x: x["v"] == F.col(variant)), lambda x: x["b"])
    full = met.select(variant, key, own.alias("_own"), "_fixed").select(
        variant, key, *(F.coalesce(F.size(bins).cast("bigint"), F.lit(0).cast("bigint")).alias(name) for name, bins in (
            ("observed_bins", F.coalesce("_own", F.array().cast("array<int>"))), ("frozen_bins", F.coalesce("_fixed", F.array().cast("array<int>"))),
            ("shared_bins", F.coalesce(F.array_intersect("_own", "_fixed"), F.array().cast("array<int>"))),
        ))
    )
    union = F.col("observed_bins") + F.col("frozen_bins") - F.col("shared_bins")
    return full.withColumn("jaccard", F.coalesce(ratio("shared_bins", union), F.lit(1.0)))


def presence_summary(overlap: DataFrame, variant: str = "variant") -> DataFrame:
    """Detected bins (quartiles), rows that differ, exact share and median Jaccard per variant.

    Bin counts have at most as many distinct values as bins. The Jaccard median is exact and comes
    from running counts.
    """
    same = (F.col("shared_bins") == F.col("observed_bins")) & (F.col("shared_bins") == F.col("frozen_bins"))
    cells = overlap.groupBy(variant, "observed_bins", "jaccard", same.alias("_same")).agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("observed_bins", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    equal = F.sum(F.when(F.col("_same"), F.col("n")).otherwise(0))
    counts = cells.groupBy(variant).agg(
        F.sum("n").alias("row_n"), q.alias("_q"), (F.sum("n") - equal).alias("rows_different_n"), (equal / F.sum("n")).alias("exact_match_rate")
    )
    leaf = cells.groupBy(variant, "jaccard").agg(F.sum("n").alias("n"))
    median = exact_quantiles(leaf, [variant], "jaccard", "n", [0.5])
    return counts.join(median, variant).select(
        variant, "row_n", F.col("_q")[1].alias("detected_median"), F.col("_q")[0].alias("detected_q25"), F.col("_q")[2].alias("detected_q75"),
        "rows_different_n", "exact_match_rate", F.col("quantiles")[0].alias("jaccard_median"),
    )


def feature_equivalence(rebuilt: DataFrame, released: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Per row the largest absolute difference and whether it is within the tolerance; absent bins are zero."""
    both = rebuilt.select(key, "bin", F.col("value").alias("a")).join(
        released.select(key, "bin", F.col("value").cast("double").alias("b")), [key, "bin"], "full"
    )
    zero = F.lit(0.0)
    per_row = both.groupBy(key).agg(
        F.max(F.abs(F.coalesce("a", zero) - F.coalesce("b", zero))).alias("max_abs_difference"), F.count("a").alias("rebuilt_bins"),
        F.count("b").alias("released_bins"),
    )
    full = rows.select(key).join(per_row, key, "left").na.fill(0)
    return full.withColumn("status", F.when(F.col("max_abs_difference") <= EQUIVALENCE_TOLERANCE, "PASS").otherwise("FAIL"))


def equivalence_summary(per_row: DataFrame) -> DataFrame:
    return per_row.agg(
        F.count(F.lit(1)).alias("row_n"), count_true(F.col("status") == "PASS").alias("pass_n"), count_true(F.col("status") == "FAIL").alias("fail_n"),
        count_true((F.col("rebuilt_bins") == 0) & (F.col("released_bins") == 0)).alias("zero_row_n"), F.max("max_abs_difference").alias("max_abs_difference"),
    )


def dense_vectors(features: DataFrame, key: str, bins: int) -> DataFrame:
    """One array per row for model input; at most ``bins`` values are gathered per row."""
    pairs = F.map_from_entries(F.collect_list(F.struct("bin", F.col("value").cast("double"))))
    filled = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return features.groupBy(key).agg(pairs.alias("_m")).select(key, filled.alias("values"))
