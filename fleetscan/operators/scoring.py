"""Scores, summaries and roll-ups from a findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscan import values as V
from fleetscan.functions.severity import (
    deploy_status,
    exit_code,
    penalty_tenths,
    pick,
    score_from_tenths,
    severity_rank,
    status_label,
    status_message,
)
from fleetscan.functions.text import line_count
from fleetscan.operators.findings import order_struct

# Every finding takes at least 0.6 points, so this many take more than 100.
FOLD_LIMIT = 1000


def _with_projects(scored: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects without findings have a row too."""
    return projects.select("project_id").distinct().join(scored, "project_id", "left")


def score(findings: DataFrame, projects: DataFrame, mode: str = "exact") -> DataFrame:
    """A1 and A2: ``project_id, score, deploy_status, exit_code``.

    ``exact`` adds tenths as integers: combinable on the map side and independent of row
    order. ``float_fold`` adds doubles one by one in output order, as a sequential program
    does, and differs only where a sum ends in .5.
    """
    critical = F.bool_or(F.col("severity") == "critical").alias("has_critical")
    if mode == "exact":
        sums = findings.groupBy("project_id").agg(
            F.sum(penalty_tenths(F.col("severity"), F.col("category"))).alias("tenths"), critical
        )
        value = score_from_tenths(F.col("tenths"))
    elif mode == "float_fold":
        weight = pick(F.col("severity"), V.SEVERITY_WEIGHT).cast("double")
        weight = weight * pick(F.col("category"), V.CATEGORY_MULTIPLIER)
        # In output order a detector's findings of one severity stand together and weigh the
        # same, so run lengths are all the fold needs: a few per project however large it is.
        # A run longer than FOLD_LIMIT has taken the score below zero for good.
        runs = findings.groupBy(
            "project_id", "severity_rank", "detector_ord", "tail", "severity", "category"
        ).agg(F.count("*").alias("n"))
        run = F.struct(
            "severity_rank",
            "detector_ord",
            "tail",
            weight.alias("w"),
            F.least(F.col("n"), F.lit(FOLD_LIMIT)).cast("int").alias("n"),
        )
        sums = runs.groupBy("project_id").agg(
            F.sort_array(F.collect_list(run)).alias("runs"), critical
        )
        folded = F.aggregate(
            "runs",
            F.lit(100.0),
            lambda acc, r: F.aggregate(F.array_repeat(r.w, r.n), acc, lambda x, w: x + w),
        )
        value = F.greatest(
            F.lit(0), F.floor(F.coalesce(folded, F.lit(100.0)) + F.lit(0.5))
        ).cast("int")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    rows = _with_projects(sums, projects).withColumn("score", value)
    status = deploy_status(F.col("score"), F.coalesce("has_critical", F.lit(False)))
    rows = rows.withColumn("deploy_status", status)
    return rows.select(
        "project_id", "score", "deploy_status", exit_code(F.col("deploy_status")).alias("exit_code")
    )


def status_texts(scores: DataFrame) -> DataFrame:
    """Display label and message of each project's status."""
    status = F.col("deploy_status")
    return scores.withColumns(
        {"status_label": status_label(status), "status_message": status_message(status)}
    )


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES]


def summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """A3: counts per severity and category, zeros included, files and lines scanned."""
    counts = findings.groupBy("project_id").agg(
        F.count("*").alias("total"),
        *_severity_counts(),
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in V.CATEGORIES],
    )
    scanned = files.groupBy("project_id").agg(
        F.count("*").alias("files_scanned"),
        F.sum(line_count(F.col("content")).cast("bigint")).alias("lines_scanned"),
    )
    numbers = ["total", *V.SEVERITIES, *[f"n_{c}" for c in V.CATEGORIES]]
    rows = scanned.join(counts, "project_id", "left").fillna(0, numbers)
    by_category = F.create_map(*[x for c in V.CATEGORIES for x in (F.lit(c), F.col(f"n_{c}"))])
    return rows.select(
        "project_id",
        "total",
        *V.SEVERITIES,
        by_category.alias("category_counts"),
        "files_scanned",
        "lines_scanned",
    )


def severity_share(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """A5: percentage of each severity, 0 where there are no findings."""
    counts = findings.groupBy("project_id").agg(F.count("*").alias("total"), *_severity_counts())
    rows = _with_projects(counts, projects).fillna(0, ["total", *V.SEVERITIES])

    def share(s: str) -> Column:
        part = F.col(s) / F.nullif(F.col("total"), F.lit(0)) * 100
        return F.coalesce(part, F.lit(0.0)).alias(f"{s}_pct")

    return rows.select("project_id", *[share(s) for s in V.SEVERITIES])


def decision(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """Why the status is what it is, and what to do next (the first step's title)."""
    counts = findings.groupBy("project_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.min_by("title", order_struct()).alias("first_title"),
    )
    rows = _with_projects(counts, projects).fillna(0, ["total", "critical", "high"])
    critical, high, total = F.col("critical"), F.col("high"), F.col("total")
    reason = (
        F.when((critical > 0) & (high > 0), F.format_string("%d critical and %d high findings.", critical, high))
        .when(critical > 0, F.format_string("%d critical findings.", critical))
        .when(high > 0, F.format_string("%d high findings.", high))
        .when(total > 0, F.format_string("%d findings.", total))
        .otherwise("Nothing stands in the way of a release.")
    )
    action = F.coalesce(
        F.concat(F.lit("First: "), F.col("first_title")), F.lit("Nothing to do.")
    )
    return rows.select("project_id", reason.alias("reason"), action.alias("next_action"))


def by_severity(findings: DataFrame) -> DataFrame:
    """The severity groups a project has, worst first by ``severity_rank``."""
    return (
        findings.groupBy("project_id", "severity")
        .agg(F.count("*").alias("n"))
        .withColumn("severity_rank", severity_rank(F.col("severity")))
    )


def fleet_cube(projects: DataFrame) -> DataFrame:
    """Projects by status and framework in all combinations of totals."""
    return projects.cube("deploy_status", "framework").agg(
        F.count("*").alias("projects"),
        F.sum("score").alias("score_sum"),
        F.sum("total").alias("findings"),
        F.grouping_id().cast("int").alias("level"),
    )
