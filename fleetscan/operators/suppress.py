"""P2 for stored findings: inline ignore comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscan.functions.text import split_lines
from fleetscan.operators.observe import DEFAULT_IGNORE_PREFIX
from fleetscan.plans.sizing import small_side


WHOLE_FILE = 0


def ignore_comments(files: DataFrame, prefix: str = DEFAULT_IGNORE_PREFIX) -> DataFrame:
    """Where ignore comments take effect: ``project_id, file, muted_line``, line 0 standing for
    the whole file. Contents are read once and not moved; only files with a comment are cut
    into lines."""
    content = F.col("content")
    commented = files.where(content.contains(f"{prefix}-disable"))
    lines = commented.select(
        "project_id",
        F.col("path").alias("file"),
        F.posexplode_outer(split_lines(content)).alias("i", "text"),
    )
    marks = [("file", F.lit(WHOLE_FILE)), ("line", F.col("i") + 1), ("next-line", F.col("i") + 2)]
    at = F.array_compact(
        F.array(*[F.when(F.col("text").contains(f"{prefix}-disable-{m}"), n) for m, n in marks])
    )
    return lines.select("project_id", "file", F.explode(at).alias("muted_line")).distinct()


def inline_ignores(
    findings: DataFrame, files: DataFrame, prefix: str = DEFAULT_IGNORE_PREFIX
) -> DataFrame:
    """Drop findings muted by a comment. Only findings with both a file and a line can be.

    The contents are read once, for the table of comments, which is stored. Two anti-joins on
    exact places: a file with many comments and many findings is no special case.
    """
    comments = small_side(ignore_comments(files, prefix))
    key = ["project_id", "file", "muted_line"]
    whole = F.when(F.col("line").isNotNull(), F.lit(WHOLE_FILE))
    kept = findings.withColumn("muted_line", whole).join(comments, key, "left_anti")
    kept = kept.withColumn("muted_line", F.col("line")).join(comments, key, "left_anti")
    return kept.select(*findings.columns)
