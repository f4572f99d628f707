"""Repair steps and plans: the output order as a number, minutes, totals, first steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscan.functions.severity import fix_minutes
from fleetscan.functions.text import clip
from fleetscan.operators.findings import ORDER_KEY, order_struct
from fleetscan.plans.sizing import stored

# monotonically_increasing_id keeps the partition number above this bit.
_ROW_BITS = 33


def ordered(findings: DataFrame) -> DataFrame:
    """``findings`` with ``order``, the 1-based place in the project's output order."""
    return _numbered(findings).select(*findings.columns, "order")


def _numbered(findings: DataFrame) -> DataFrame:
    """``findings`` with ``order`` and the project's numbers of critical and high findings.

    A window per project would sort a huge project in one task. Instead the rows are
    range-partitioned on (project, order key), so a project spreads over as many tasks as
    its size asks for, and numbered inside each partition; what is then needed to continue
    the count from one partition to the next is one row per partition. The numbered rows are
    written out once, because partition numbers must not change between the two uses.
    Range partitioning samples its input first, so pass findings that are stored, or cheap.
    """
    keyed = findings.withColumns(
        {"file_key": F.coalesce("file", F.lit("")), "line_key": F.coalesce("line", F.lit(0))}
    )
    key = ["project_id", *ORDER_KEY]
    placed = stored(
        keyed.repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .withColumn("place", F.monotonically_increasing_id())
        .drop("file_key", "line_key")
    )
    part = F.shiftrightunsigned("place", _ROW_BITS)
    row = F.col("place").bitwiseAND((1 << _ROW_BITS) - 1)
    # One row per partition: bounded by the number of shuffle partitions.
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = (
        placed.withColumn("part", part)
        .join(F.broadcast(starts), "part")
        .withColumn("position", F.col("start") + row)
    )
    projects = numbered.groupBy("project_id").agg(
        F.min("position").alias("first_position"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("severity") == "high").alias("n_high"),
    )
    order = (F.col("position") - F.col("first_position") + 1).cast("int")
    return numbered.join(projects, "project_id").withColumn("order", order)


def repair_steps(findings: DataFrame) -> DataFrame:
    """One step per finding with its place, minutes and the running total of minutes.

    The running total (W3) needs no window: severities come in order, so it follows from the
    place and the numbers of critical and high findings.
    """
    place, c, h = F.col("order"), F.col("n_critical"), F.col("n_high")
    past_critical = F.greatest(place - c, F.lit(0))
    past_high = F.greatest(place - c - h, F.lit(0))
    total = 15 * F.least(place, c) + 10 * F.least(past_critical, h) + 5 * past_high
    return _numbered(findings).select(
        "project_id",
        "order",
        F.col("id").alias("finding_id"),
        "title",
        "severity",
        "category",
        "file",
        "line",
        F.col("why_it_matters").alias("description"),
        "fix_steps",
        "ai_fix_prompt",
        "auto_fix_available",
        fix_minutes(F.col("severity")).alias("estimated_minutes"),
        total.cast("bigint").alias("cumulative_minutes"),
    )


def repair_plan(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """A4: total minutes and a sentence. A sum, so no ordering is involved."""
    sums = findings.groupBy("project_id").agg(
        F.count("*").alias("steps"), F.sum(fix_minutes(F.col("severity"))).alias("minutes")
    )
    rows = projects.select("project_id").distinct().join(sums, "project_id", "left")
    rows = rows.fillna(0, ["steps", "minutes"])
    sentence = F.format_string(
        "%d findings to work through, about %d minutes in all.", F.col("steps"), F.col("minutes")
    )
    return rows.select(
        "project_id", "steps", F.col("minutes").alias("estimated_minutes"), sentence.alias("summary")
    )


def top_steps(findings: DataFrame, k: int = 1, salts: int = 64) -> DataFrame:
    """The first ``k`` findings of each project with their ``order``.

    Ranked per salt first, so no task holds more than ``salts * k`` rows of a project.
    """
    salted = findings.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    salted = salted.withColumn("key", order_struct())
    per_salt = W.partitionBy("project_id", "salt").orderBy("key")
    heads = salted.withColumn("n", F.row_number().over(per_salt)).where(F.col("n") <= k)
    per_project = W.partitionBy("project_id").orderBy("key")
    return (
        heads.withColumn("order", F.row_number().over(per_project))
        .where(F.col("order") <= k)
        .drop("salt", "key", "n")
    )


def step_findings(steps: DataFrame, findings: DataFrame) -> DataFrame:
    """Steps with their finding's rule, problem and one-line evidence."""
    rows = findings.select(
        "project_id",
        F.col("id").alias("finding_id"),
        "rule_id",
        "plain_english_problem",
        clip(F.col("evidence")).alias("shown_evidence"),
    )
    return steps.join(rows, ["project_id", "finding_id"])
