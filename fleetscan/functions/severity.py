"""Severity, score and deploy-status functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscan import values as V

# Display labels and messages (our own wording).
STATUS_LABEL = {
    "blocker": "Do not deploy",
    "danger": "Do not deploy",
    "warning": "Fix before release",
    "safe": "Ready to deploy",
}
STATUS_MESSAGE = {
    "blocker": "At least one critical issue is open; resolve it first.",
    "danger": "Too many open issues for a release.",
    "warning": "Some issues should be dealt with before going live.",
    "safe": "Only minor improvements are left.",
}

SEVERITY_LABEL = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low"}


def pick(col: Column, table: dict, default=None) -> Column:
    """A lookup in a small fixed table, as a CASE expression."""
    out = None
    for key, value in table.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(default)


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low: smaller is worse."""
    return pick(severity, V.SEVERITY_RANK)


def more_severe(a: Column, b: Column) -> Column:
    return severity_rank(a) < severity_rank(b)


def max_severity(a: Column, b: Column) -> Column:
    return F.when(severity_rank(a) <= severity_rank(b), a).otherwise(b)


def worst_severity(severity: Column) -> Column:
    """Aggregate: the most severe value of a group."""
    ranks = F.array(*[F.lit(s) for s in V.SEVERITIES])
    return F.get(ranks, F.min(severity_rank(severity)))


def at_least(severity: Column, minimum: str) -> Column:
    """Keeps ``minimum`` and everything worse."""
    keep = [s for s in V.SEVERITIES if V.SEVERITY_RANK[s] <= V.SEVERITY_RANK[minimum]]
    return severity.isin(keep)


def penalty_tenths_of(severity: str, category: str) -> int:
    """Penalty of one finding in tenths of a point; a whole number for every combination."""
    return round(V.SEVERITY_WEIGHT[severity] * V.CATEGORY_MULTIPLIER[category] * 10)


def penalty_tenths(severity: Column, category: Column) -> Column:
    """Column form of :func:`penalty_tenths_of`; integers, so sums do not depend on row order."""
    weight = pick(severity, V.SEVERITY_WEIGHT)
    tenths = {c: round(m * 10) for c, m in V.CATEGORY_MULTIPLIER.items()}
    return (weight * pick(category, tenths)).cast("bigint")


def score_from_tenths(total_tenths: Column) -> Column:
    """100 plus the penalties, rounded half up and floored at 0."""
    scaled = F.lit(1005) + F.coalesce(total_tenths, F.lit(0))
    return F.greatest(F.lit(0), F.floor(scaled / 10)).cast("int")


def deploy_status(score: Column, has_critical: Column) -> Column:
    return (
        F.when(has_critical, "blocker")
        .when(score < V.DANGER_BELOW, "danger")
        .when(score < V.WARNING_BELOW, "warning")
        .otherwise("safe")
    )


def exit_code(status: Column) -> Column:
    """Release gate: 1 stops the release, 0 lets it pass."""
    return F.when(status.isin("blocker", "danger"), 1).otherwise(0)


def fix_minutes(severity: Column) -> Column:
    return pick(severity, V.FIX_MINUTES)


def editor_level(severity: Column) -> Column:
    """How an editor marks a finding."""
    return F.when(severity.isin("critical", "high"), "error").otherwise("warning")


def status_label(status: Column) -> Column:
    return pick(status, STATUS_LABEL)


def status_message(status: Column) -> Column:
    return pick(status, STATUS_MESSAGE)


def severity_label(severity: Column) -> Column:
    return pick(severity, SEVERITY_LABEL)
