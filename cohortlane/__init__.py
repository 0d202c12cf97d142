"""Spark operators for leakage-free cohorts, binned spectra and grouped classifier evaluation."""

__version__ = "0.1.0"
