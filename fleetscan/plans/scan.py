"""A whole scan as one plan: selection, rules, project level, results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscan.config import ScanConfig, rule_mask, validate_configs, with_all_settings
from fleetscan.operators.context import (
    CONTEXT_COLUMNS,
    add_findings,
    combined,
    contributions,
    facts_of,
    project_summary,
)
from fleetscan.operators.findings import FINDING_SCHEMA, describe, file_hits, project_hits
from fleetscan.operators.gitignore import parse_rules
from fleetscan.operators.observe import observe
from fleetscan.operators.repair import repair_plan, repair_steps
from fleetscan.operators.selection import mark_capped, mark_selected
from fleetscan.plans.sizing import among, broadcast_if_small, small_side, stored
from fleetscan.rules.builtin import default_registry
from fleetscan.rules.model import Registry
from fleetscan.sources.trees import skipped_files

# Where the patterns of a project's options stand among its rules: behind those of its own file.
AFTER_OWN_RULES = 1 << 24
ERROR_SCHEMA = "project_id string, detector_id string, detector_name string, message string"


@dataclass
class ScanTables:
    """The results of a scan, as lazy tables over one stored observation table and the stored
    sums of its projects (``contributions``), and what a rescan needs to go on from them."""

    files: DataFrame
    observations: DataFrame
    contributions: DataFrame
    facts: DataFrame
    context: DataFrame
    findings: DataFrame
    projects: DataFrame
    errors: DataFrame
    config: ScanConfig
    registry: Registry
    settings: DataFrame | None = None

    @property
    def steps(self) -> DataFrame:
        return repair_steps(self.findings)

    @property
    def plan(self) -> DataFrame:
        return repair_plan(self.findings, self.facts)


def detector_errors(facts: DataFrame) -> DataFrame:
    """Manifests the dependency detector cannot work with."""
    return facts.where("manifest_error is not null").select(
        "project_id",
        F.lit("dependency-detector").alias("detector_id"),
        F.lit("Dependencies and install scripts").alias("detector_name"),
        F.col("manifest_error").alias("message"),
    )


def _reader_errors(project: DataFrame, message) -> DataFrame:
    return project.select(
        "project_id",
        F.lit("reader").alias("detector_id"),
        F.lit("File reader").alias("detector_name"),
        message.alias("message"),
    )


def left_out_errors(left_out: DataFrame) -> DataFrame:
    """One row per project of which the cap on files left some out."""
    return _reader_errors(
        left_out, F.format_string("%d files beyond the cap were left out", "left_out")
    )


def run_detectors(
    registry: Registry, files: DataFrame, context: DataFrame, isolate: bool = True
) -> tuple[DataFrame | None, DataFrame | None]:
    """Custom detectors. One that fails becomes an error row of every project and the others go
    on. With ``isolate``, the rows of each detector are stored by themselves as soon as it is
    planned, so one that fails inside a task is told like one that cannot be planned; without,
    such an error fails the job that reads the findings."""
    found, failed = [], []
    columns = [c.split()[0] for c in FINDING_SCHEMA.split(", ")]
    for spec in sorted(registry.detectors, key=lambda d: d.order):
        try:
            rows = spec.detect(files, context).select(*columns)
            found.append(stored(rows) if isolate else rows)
        except Exception as e:  # noqa: BLE001 - whatever a foreign detector raises
            failed.append(
                context.select(
                    "project_id",
                    F.lit(spec.id).alias("detector_id"),
                    F.lit(spec.name).alias("detector_name"),
                    F.lit(_told(e)).alias("message"),
                )
            )

    def union(parts):
        return reduce(DataFrame.unionByName, parts) if parts else None

    return union(found), union(failed)


def _told(error: Exception) -> str:
    """The first line of an error, its stack left out."""
    lines = [x for x in str(error).splitlines() if x.strip()]
    return (lines[0] if lines else type(error).__name__)[:500]


def _settings_of(settings: DataFrame, registry: Registry) -> tuple[DataFrame, DataFrame]:
    """Valid rows with the mask of their rules (``active``), and error rows of the others."""
    checked = with_all_settings(validate_configs(settings))
    checked = stored(checked.withColumn("active", rule_mask(registry.rules)))
    errors = checked.where("error is not null").select(
        "project_id",
        F.lit("config").alias("detector_id"),
        F.lit("Options of the project").alias("detector_name"),
        F.concat(F.lit("Invalid configuration: "), "error").alias("message"),
    )
    return checked, errors


def _marked(
    raw_files: DataFrame, config: ScanConfig, targets: DataFrame | None, settings: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """All files marked as selected or not, and how many files a cap left out."""
    if settings is None:
        marked = mark_selected(raw_files, config.exclude_patterns, None, targets, config.ignore_case)
        return (marked, None) if config.max_files is None else mark_capped(marked, config.max_files)
    patterns = settings.select(
        "project_id", F.posexplode("exclude_patterns").alias("seq", "pattern")
    ).withColumn("seq", F.col("seq") + AFTER_OWN_RULES)
    marked = mark_selected(
        raw_files, config.exclude_patterns, None, targets, config.ignore_case,
        parse_rules(patterns, config.ignore_case),
    )
    options = settings.select("project_id", "active", "error", "max_files")
    met = marked.join(broadcast_if_small(options), "project_id", "left")
    met = met.where("error is null").drop("error").withColumn("active", F.coalesce("active", F.lit(-1).cast("bigint")))
    limit = F.coalesce(F.col("max_files"), F.lit(config.max_files).cast("int"))
    capped, left_out = mark_capped(met, limit)
    return capped.drop("max_files"), left_out


def scan(
    raw_files: DataFrame,
    config: ScanConfig | None = None,
    registry: Registry | None = None,
    targets: DataFrame | None = None,
    store: bool = True,
    settings: DataFrame | None = None,
) -> ScanTables:
    """Scan ``raw_files(project_id, path, content)``, the unfiltered listing of a fleet.

    Contents are read once: the rule projection's compact output is stored in the shared
    folder and every result is computed from it. A cap on files that cuts a project, and files
    that the reader left out (column ``skipped``), are error rows. With ``store=False`` nothing is written and
    each result that is used reads the contents again.

    ``settings`` has options of single projects (:data:`fleetscan.config.SETTINGS`); a project
    without a row, and an option that is null, keeps those of ``config``. They are data: one mask of
    rules for each project takes part in the same pass. A project with invalid options is not
    scanned; an error row says why.
    """
    config = (config or ScanConfig(root=".")).validated()
    registry = (registry or default_registry()).active(
        config.enabled_categories, config.min_severity
    )
    errors = None
    if settings is not None:
        settings, errors = _settings_of(settings, registry)
    marked, left_out = _marked(raw_files, config, targets, settings)
    observations = observe(marked, registry, config.ignore_prefix)
    if store:
        observations = stored(observations)
    parts = contributions(observations, registry)
    if store:
        parts = stored(parts)
    if left_out is not None:
        cut = left_out_errors(left_out)
        errors = cut if errors is None else errors.unionByName(cut)
    if "skipped" in raw_files.columns:
        skipped = skipped_files(raw_files)
        errors = skipped if errors is None else errors.unionByName(skipped)
    files = marked.where("selected").drop("selected", "active")
    return _tables(files, observations, parts, config, registry, settings, errors, store)


def _tables(files, observations, parts, config, registry, settings, errors, store=True) -> ScanTables:
    """All results from observations and the sums of projects."""
    facts = facts_of(parts, registry)
    if settings is not None:
        mask = broadcast_if_small(settings.select("project_id", "active"))
        facts = facts.join(mask, "project_id", "left").withColumn(
            "active", F.coalesce("active", F.lit(-1).cast("bigint"))
        )
    context = facts.select("project_id", *CONTEXT_COLUMNS)
    hits = file_hits(observations).unionByName(project_hits(facts, registry))
    findings = describe(hits, registry)
    projects = project_summary(facts, registry)
    found = detector_errors(facts)
    errors = found if errors is None else found.unionByName(errors)
    if registry.detectors:
        extra, failed = run_detectors(registry, files, context, isolate=store)
        errors = errors if failed is None else errors.unionByName(failed)
        if extra is not None:
            findings = findings.unionByName(extra)
            projects = add_findings(projects, extra)
    return ScanTables(
        files, observations, parts, facts, context, findings, projects, errors, config, registry, settings
    )


@dataclass
class Rescan:
    """``tables``: the results as of now; ``scope``: ``project_id, file`` of what was looked at again;
    ``partial``: the findings of these files, and those of their projects that depend on all files."""

    tables: ScanTables
    scope: DataFrame
    partial: DataFrame


def rescan(before: ScanTables, files: DataFrame, changed: DataFrame) -> Rescan:
    """The results for ``files``, the whole listing as of now, from those of an earlier scan and
    ``changed(project_id, path)``: files changed, added or removed since.

    Rules look at changed files only. In the projects concerned, files that came under or out of
    an ignore rule, a cap or the listing are found by their paths and count as changed. What the
    earlier versions added to their projects is taken away and what the new ones add is put in its
    place. Targets and custom detectors are those of a whole scan and not taken up here.
    """
    config, registry, settings = before.config, before.registry, before.settings
    marked, left_out = _marked(files, config, None, settings)
    told = stored(changed.select("project_id", "path").distinct())
    projects = small_side(told.select("project_id").distinct())
    now = marked.select("project_id", "path", F.col("selected").alias("now"))
    known = before.observations.where("rule_no = 0").select(
        "project_id", "path", F.col("selected").alias("known")
    )
    moved = (
        now.join(projects, "project_id", "left_semi")
        .join(known.join(projects, "project_id", "left_semi"), ["project_id", "path"], "full")
        .where(~F.col("now").eqNullSafe(F.col("known")))
        .select("project_id", "path")
    )
    scope = small_side(told.union(moved).distinct())
    new = stored(
        observe(among(marked, scope, ["project_id", "path"]), registry, config.ignore_prefix)
    )
    old = before.observations.join(scope, ["project_id", "path"], "left_semi")
    observations = before.observations.join(scope, ["project_id", "path"], "left_anti").unionByName(new)
    parts = before.contributions.unionByName(contributions(old, registry, -1)).unionByName(
        contributions(new, registry)
    )
    errors = None if left_out is None else left_out_errors(left_out)
    tables = _tables(
        marked.where("selected").drop("selected", "active"), observations, stored(combined(parts)), config,
        Registry(registry.rules), settings, errors,
    )
    affected = scope.select("project_id").distinct()
    level = project_hits(tables.facts.join(affected, "project_id", "left_semi"), registry)
    partial = describe(file_hits(new).unionByName(level), registry)
    return Rescan(tables, scope.withColumnRenamed("path", "file"), partial)
