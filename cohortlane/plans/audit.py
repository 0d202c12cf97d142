"""The label audit end to end: scope, collapse, inventory, funnel, panel mapping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlane.operators import labels as L
from cohortlane.session import packed


@dataclass(frozen=True)
class LabelAudit:
    collapsed: DataFrame
    inventory: DataFrame
    funnel: DataFrame
    mapping: DataFrame


def collapsed_with_features(labels: DataFrame, samples: DataFrame, order: Sequence[str], **scope) -> DataFrame:
    """Features are linked to the label rows, which may be dealt by sample already, so that collapsed rows are not dealt once more."""
    available = L.available_samples(samples.withColumn("sample_id", F.col("sample_id").cast("string")))
    return L.collapse_labels(L.normalize_labels(L.scope_labels(L.link_features(labels, available), **scope)), order)


def label_audit(
    labels: DataFrame, samples: DataFrame, order: Sequence[str], panel: Sequence[dict], thresholds: L.SupportThresholds = L.SupportThresholds(),
    *, sites: Sequence[str] | None = None, year_min: int | None = None, year_max: int | None = None, store: bool = True,
) -> LabelAudit:
    """All four audit tables. The collapsed table feeds three of them and is stored once by default."""
    scope = {"sites": sites, "year_min": year_min, "year_max": year_max}
    scoped = L.normalize_labels(L.scope_labels(labels, **scope))
    collapsed = collapsed_with_features(labels, samples, order, **scope)
    if store:
        collapsed = packed(collapsed)
    inventory = L.combination_inventory(collapsed, thresholds)
    return LabelAudit(
        collapsed, inventory, L.support_funnel(scoped, collapsed, inventory, thresholds),
        L.panel_mapping(inventory, panel, "no documented rationale"),
    )
