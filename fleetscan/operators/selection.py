"""Which files are scanned: names and extensions, excluded directories, ignore rules,
explicit targets and the cap on files per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetscan import values as V
from fleetscan.functions import content as C
from fleetscan.functions import paths as P
from fleetscan.operators.gitignore import (
    file_rule_sets,
    ignore_rules,
    with_ignored,
    with_ignored_by_sets,
)
from fleetscan.plans.reuse import once
from fleetscan.plans.sizing import broadcast_if_small, small_side

SALTS = 64


@once
def selectable(ignore_case: bool = True) -> Column:
    """decided by the ``path`` alone."""
    return P.scannable(F.col("path")) & ~P.excluded(F.col("path"), ignore_case)


def mark_selected(
    files: DataFrame,
    exclude_patterns=(),
    max_files: int | None = None,
    targets: DataFrame | None = None,
    ignore_case: bool = True,
    more_rules: DataFrame | None = None,
) -> DataFrame:
    """All files with a column ``selected``. Contents are only passed through: rules, targets
    and the cap are worked out on paths and come back as small tables. Files that the
    reader left out (``skipped``, where there is such a column) are not selected."""
    if targets is not None:
        wanted = broadcast_if_small(targets.select("project_id", "path").distinct())
        out = files.join(wanted.withColumn("selected", F.lit(True)), ["project_id", "path"], "left")
        out = out.withColumn("selected", F.coalesce("selected", F.lit(False)))
    else:
        if more_rules is None:
            sets = file_rule_sets(files, ignore_case)
            out = with_ignored_by_sets(files, sets, ignore_case, exclude_patterns)
        else:
            rules = ignore_rules(files, ignore_case).unionByName(more_rules)
            out = with_ignored(files, rules, ignore_case, exclude_patterns)
        out = out.withColumn("selected", selectable(ignore_case) & ~F.col("ignored"))
        out = out.drop("ignored")
    if "skipped" in files.columns:
        out = out.withColumn("selected", F.col("selected") & F.col("skipped").isNull())
    return out if max_files is None else mark_capped(out, max_files)[0]


def mark_capped(marked: DataFrame, max_files: int | Column) -> tuple[DataFrame, DataFrame]:
    """``marked`` with only the first ``max_files`` files of each project still selected (a column
    may give each project a cap of its own, null for none), and for each project that this
    cuts ``project_id, left_out``: how many files."""
    cut = small_side(last_kept_paths(marked.where("selected"), max_files))
    joined = marked.join(cut, "project_id", "left")
    within = F.col("last_path").isNull() | (F.col("path") <= F.col("last_path"))
    left_out = joined.where(F.col("selected") & ~within).groupBy("project_id").agg(
        F.count("*").alias("left_out")
    )
    return joined.withColumn("selected", F.col("selected") & within).drop("last_path"), left_out


def select_files(files: DataFrame, **options) -> DataFrame:
    """Only the selected files; options as for :func:`mark_selected`."""
    return mark_selected(files, **options).where("selected").drop("selected")


def target_files(files: DataFrame, targets: DataFrame) -> DataFrame:
    """An explicit list of ``project_id, path`` in place of discovery."""
    wanted = broadcast_if_small(targets.select("project_id", "path"))
    return files.join(wanted, ["project_id", "path"], "left_semi")


def last_kept_paths(files: DataFrame, max_files: int | Column) -> DataFrame:
    """For each project with more than ``max_files`` files, the last path kept in path order.

    The first ``max_files`` paths are taken per salt and only then per project, so no task
    ever ranks more than ``SALTS * max_files`` paths of one project. Projects within the
    cap give no row.
    """
    limit = max_files if isinstance(max_files, Column) else F.lit(max_files)
    keys = files.select("project_id", "path", limit.alias("most"))
    if isinstance(max_files, Column):
        keys = keys.where("most is not null")
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS))
    per_salt = W.partitionBy("project_id", "salt").orderBy("path")
    heads = (
        keys.withColumn("salt", salt)
        .withColumn("n", F.row_number().over(per_salt))
        .where(F.col("n") <= F.col("most") + 1)
    )
    per_project = W.partitionBy("project_id").orderBy("path")
    ranked = heads.withColumn("n", F.row_number().over(per_project))
    return (
        ranked.where(F.col("n") <= F.col("most") + 1)
        .groupBy("project_id")
        .agg(
            F.max(F.col("n") - F.col("most")).alias("over"),
            F.max(F.when(F.col("n") <= F.col("most"), F.col("path"))).alias("last_path"),
        )
        .where("over > 0")
        .select("project_id", "last_path")
    )


def cap_files(files: DataFrame, max_files: int = V.DEFAULT_MAX_FILES) -> DataFrame:
    """The first ``max_files`` files of each project in path order."""
    cut = small_side(last_kept_paths(files, max_files))
    out = files.join(cut, "project_id", "left")
    kept = F.col("last_path").isNull() | (F.col("path") <= F.col("last_path"))
    return out.where(kept).drop("last_path")


def classify(files: DataFrame) -> DataFrame:
    """F5-F14 as columns, one row per file; no content in the result."""
    path, content = F.col("path"), F.col("content")
    return files.select(
        "project_id",
        "path",
        P.is_code(path).alias("is_code"),
        P.is_app_code(path).alias("is_app_code"),
        P.is_api_route(path).alias("is_api_route"),
        P.is_risky_route(path).alias("is_risky_route"),
        P.is_admin_route(path).alias("is_admin_route"),
        C.is_client(path, content).alias("is_client"),
        C.is_server(path, content).alias("is_server"),
        C.file_side(path, content).alias("file_side"),
        C.has_mutating_handler(content).alias("has_mutating_handler"),
        C.has_auth(content).alias("has_auth"),
        C.has_authorization(content).alias("has_authorization"),
        C.reads_body(content).alias("reads_body"),
        C.has_validation(content).alias("has_validation"),
    )
