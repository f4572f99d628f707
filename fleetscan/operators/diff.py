"""Comparing and merging scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscan.plans.sizing import broadcast_if_small
from fleetscan.rules.builtin import default_registry
from fleetscan.rules.model import ProjectRule, Registry

IDENTITY = ["project_id", "rule_id", "file", "line"]


def scan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What is new, resolved or persisting between two scans.

    Findings are the same when project, rule, file and line agree, absent values included.
    One aggregation over both scans: it combines on the map side and cannot multiply rows.
    """
    tagged = before.select(*IDENTITY, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(*IDENTITY, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    sums = tagged.groupBy(*IDENTITY).agg(
        F.sum("b").alias("n_before"), F.sum("a").alias("n_after")
    )
    status = (
        F.when(F.col("n_before") == 0, "new")
        .when(F.col("n_after") == 0, "resolved")
        .otherwise("persisting")
    )
    return sums.withColumn("status", status)


def verify_fixes(fixed: DataFrame, after: DataFrame) -> DataFrame:
    """Findings a fix was meant to remove, with ``still_exists`` from a later scan."""
    rows = scan_diff(fixed, after).where("n_before > 0")
    return rows.select(*IDENTITY, (F.col("n_after") > 0).alias("still_exists"))


def merge_findings(
    full: DataFrame, partial: DataFrame, scope: DataFrame, registry: Registry | None = None
) -> DataFrame:
    """``full`` with everything about the rescanned files replaced by ``partial``.

    ``scope(project_id, file)`` lists the rescanned files, those that are now clean
    included. Project-level findings of the projects in scope are replaced too, as they
    depend on every file.
    """
    registry = registry or default_registry()
    project_rules = [r.rule_id for _, r in registry.numbered(ProjectRule)]
    project_level = F.col("file").isNull() | F.col("rule_id").isin(project_rules)
    scope = scope.select("project_id", "file").distinct()
    files = broadcast_if_small(scope)
    projects = broadcast_if_small(scope.select("project_id").distinct())
    return (
        full.where(~project_level)
        .join(files, ["project_id", "file"], "left_anti")
        .unionByName(full.where(project_level).join(projects, "project_id", "left_anti"))
        .unionByName(partial)
    )
