"""Risk per dataset from personal data, staleness and centrality, its summary, and the full context."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.operators.freshness import SLA_HOURS
from plumbrow.operators.profile import FINDING
from plumbrow.sources.shared import cut

# Weights and limits of the two formulas.
PII_WEIGHT = 0.4
FRESHNESS_CAP = 0.4
CENTRALITY_WEIGHT = 0.2
HIGH_RISK = 0.65
NOTES_CENTRALITY_WEIGHT = 0.4
NOTES_PII_WEIGHT = 0.4
NOTES_ORPHAN_WEIGHT = 0.2
NOTES_STALE_WEIGHT = 0.1

STANDARD, WEIGHTED = "standard", "weighted"


def _or(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _share(flag: Column, weight: float) -> Column:
    return F.when(flag, F.lit(weight)).otherwise(F.lit(0.0))


def risk_score(df: DataFrame) -> DataFrame:
    """Adds ``risk_score`` and ``is_high_risk`` from ``has_pii, hours_stale, centrality``.

    Staleness counts 1/24 per hour up to 0.4, which it reaches after 9.6 hours.
    """
    stale = F.least(_or("hours_stale", 0.0) / 24.0, F.lit(FRESHNESS_CAP))
    raw = _share(_or("has_pii", False), PII_WEIGHT) + stale + _or("centrality", 0.0) * CENTRALITY_WEIGHT
    score = F.round(F.least(raw, F.lit(1.0)), 2)
    return df.withColumns({"risk_score": score, "is_high_risk": score >= HIGH_RISK})


def risk_score_weighted(df: DataFrame, sla_hours: float = SLA_HOURS) -> DataFrame:
    """The second formula, from ``has_pii, hours_stale, centrality, is_orphan``.

    Also adds ``has_freshness_issue`` and rounds the hours to one place.
    """
    hours = _or("hours_stale", 0.0)
    stale = hours > sla_hours
    raw = (
        _or("centrality", 0.0) * NOTES_CENTRALITY_WEIGHT
        + _share(_or("has_pii", False), NOTES_PII_WEIGHT)
        + _share(_or("is_orphan", False), NOTES_ORPHAN_WEIGHT)
        + _share(stale, NOTES_STALE_WEIGHT)
    )
    score = F.round(F.least(raw, F.lit(1.0)), 3)
    return df.withColumns(
        {
            "risk_score": score,
            "is_high_risk": score >= HIGH_RISK,
            "has_freshness_issue": stale,
            "hours_stale": F.round(hours, 1),
        }
    )


def score_all(
    registry: DataFrame,
    freshness: DataFrame,
    centrality: DataFrame,
    roles: DataFrame | None = None,
    formula: str = STANDARD,
) -> DataFrame:
    """One row per registered dataset: its inputs and its score.

    ``registry(urn, pii_columns, has_pii)``, ``freshness(dataset, hours_stale, is_stale)``,
    ``centrality(id, centrality)``, ``roles(id, is_orphan)``; the graph was computed once, and a
    dataset missing from one of them counts as fresh, not central, no orphan.
    """
    known = [c for c in ("urn", "table", "pii_columns", "has_pii") if c in registry.columns]
    out = (
        registry.select(*known)
        .join(freshness.select(F.col("dataset").alias("urn"), "hours_stale", "is_stale"), "urn", "left")
        .join(centrality.select(F.col("id").alias("urn"), "centrality"), "urn", "left")
    )
    if roles is not None:
        out = out.join(roles.select(F.col("id").alias("urn"), "is_orphan"), "urn", "left")
    else:
        out = out.withColumn("is_orphan", F.lit(False))
    out = out.withColumns(
        {
            "hours_stale": _or("hours_stale", 0.0),
            "is_stale": _or("is_stale", False),
            "centrality": _or("centrality", 0.0),
            "is_orphan": _or("is_orphan", False),
        }
    )
    if formula == WEIGHTED:
        return risk_score_weighted(out)
    if formula != STANDARD:
        raise ValueError(f"unknown formula {formula!r}")
    return risk_score(out)


def risk_summary(scores: DataFrame) -> DataFrame:
    """One row of totals. The datasets behind each number come from the two lists below."""
    return scores.agg(
        F.count(F.lit(1)).alias("total_evaluated"),
        F.count_if("is_high_risk").alias("high_risk_count"),
        F.count_if("is_stale").alias("freshness_count"),
        F.count_if("has_pii").alias("pii_count"),
    )


def freshness_vulnerabilities(scores: DataFrame) -> DataFrame:
    return scores.filter("is_stale").select("urn", "hours_stale", "risk_score")


def pii_vulnerabilities(scores: DataFrame) -> DataFrame:
    return scores.filter("has_pii").select("urn", F.col("pii_columns").alias("pii_fields"))


class GovernanceContext(NamedTuple):
    """``datasets``: one row each, with its findings; ``edges``: lineage, hence downstream lists."""

    datasets: DataFrame
    edges: DataFrame


def governance_context(
    registry: DataFrame,
    edges: DataFrame,
    freshness: DataFrame,
    centrality: DataFrame,
    anomalies: DataFrame,
    formula: str = STANDARD,
) -> GovernanceContext:
    """Per dataset: centrality, risk, personal data, number of downstream datasets, findings.

    The findings of a dataset go into one array: its columns bound their number. Downstream
    datasets do not, as a hub may feed most of the graph: they stay rows of ``edges`` and each
    dataset carries their count.
    """
    edges = edges.select("src", "dst").filter("src <> dst").distinct()
    below = edges.groupBy(F.col("src").alias("urn")).agg(F.count(F.lit(1)).alias("downstream_count"))
    finding = F.struct(
        "column", "column_2", "issue", "bad_rows", "total_rows", "pct", "min_value", "low", "high", "parsed_share"
    )
    found = anomalies.groupBy(F.col("dataset").alias("urn")).agg(
        F.sort_array(F.collect_list(finding)).alias("statistical_profile")
    )
    # Written, so that no task holds what all five joins sort at once.
    scores = cut(score_all(registry, freshness, centrality, formula=formula), "scores")
    datasets = (
        scores.join(below, "urn", "left")
        .join(found, "urn", "left")
        .select(
            "urn", F.col("table").alias("table_name"),
            F.round("centrality", 4).alias("centrality"),
            "risk_score", "is_high_risk", "pii_columns",
            _or("downstream_count", 0).alias("downstream_count"),
            F.coalesce("statistical_profile", F.array().cast(f"array<{FINDING}>")).alias("statistical_profile"),
        )
    )
    return GovernanceContext(datasets, edges)


def write_context(context: GovernanceContext, path: str) -> None:
    """Write the context as JSON lines, one folder for datasets and one for edges."""
    context.datasets.write.mode("overwrite").json(f"{path.rstrip('/')}/datasets")
    context.edges.write.mode("overwrite").json(f"{path.rstrip('/')}/lineage_edges")
