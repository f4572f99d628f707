"""Findings: from rule numbers to full rows, deterministic ids and the output order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscan import values as V
from fleetscan.functions.severity import severity_rank
from fleetscan.functions.text import fill
from fleetscan.operators.context import with_project_hits
from fleetscan.plans.reuse import once
from fleetscan.plans.sizing import broadcast_if_small
from fleetscan.rules.model import ProjectRule, Registry

FINDING_SCHEMA = (
    "project_id string, id string, rule_id string, title string, severity string, "
    "category string, deploy_blocking boolean, confidence string, file string, line int, "
    "end_line int, column int, end_column int, evidence string, plain_english_problem string, "
    "why_it_matters string, fix_steps array<string>, auto_fix_available boolean, "
    "ai_fix_prompt string, learn_more_url string, related_findings array<string>, "
    "tags array<string>, severity_rank int, detector_ord int, tail int, rule_ord int, ordinal int"
)

# The output order: severity first, then the order in which detectors emit.
ORDER_KEY = ["severity_rank", "detector_ord", "tail", "file_key", "line_key", "rule_ord", "ordinal"]


def order_struct() -> Column:
    """The output order as one comparable value."""
    return F.struct(
        "severity_rank",
        "detector_ord",
        "tail",
        F.coalesce("file", F.lit("")).alias("file_key"),
        F.coalesce("line", F.lit(0)).alias("line_key"),
        "rule_ord",
        "ordinal",
    )


def finding_id(prefix: Column, ordinal: Column) -> Column:
    """Stable across scans: prefix and a hash of project, rule, place and ordinal."""
    key = F.concat_ws(
        "|",
        F.coalesce("project_id", F.lit("")),
        "rule_id",
        F.coalesce("file", F.lit("")),
        F.coalesce(F.col("line").cast("string"), F.lit("")),
        ordinal.cast("string"),
    )
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(key, 256), 1, 12))


def file_hits(observations: DataFrame) -> DataFrame:
    """Hits of line and file rules, still by rule number."""
    return observations.where("rule_no > 0").select(
        "project_id",
        "rule_no",
        F.col("path").alias("file"),
        F.when(F.col("line") > 0, F.col("line")).alias("line"),
        "evidence",
        "detail",
        F.lit(0).alias("ordinal"),
    )


def project_hits(facts: DataFrame, registry: Registry) -> DataFrame:
    """Hits of project rules, still by rule number."""
    rows = with_project_hits(facts, registry)
    return rows.select(*_project_hit_columns(tuple(registry.rules))).select(
        "project_id",
        "rule_no",
        "file",
        F.lit(None).cast("int").alias("line"),
        "evidence",
        "detail",
        "ordinal",
    )


@once
def _project_hit_columns(rules: tuple) -> list:
    none = F.array().cast(
        "array<struct<rule_no:int,file:string,evidence:string,detail:string,ordinal:int>>"
    )

    def numbered(no: int) -> Column:
        return F.transform(
            f"hits_{no}",
            lambda h: F.struct(
                F.lit(no).alias("rule_no"),
                h.file.alias("file"),
                h.evidence.alias("evidence"),
                h.detail.alias("detail"),
                h.ordinal.alias("ordinal"),
            ),
        )

    hits = [numbered(no) for no, _ in Registry(rules).numbered(ProjectRule)]
    return ["project_id", F.inline(F.concat(none, *hits))]


def describe(hits: DataFrame, registry: Registry) -> DataFrame:
    """Full findings rows from hits. The catalogue is a literal indexed by rule number,
    so the texts join without a shuffle and only where rows are final."""
    if not registry.rules:
        return hits.sparkSession.createDataFrame([], FINDING_SCHEMA)

    rule, columns = _description(tuple(registry.rules))
    return hits.withColumns(rule).withColumn("rule_id", F.col("rule.rule_id")).select(*columns)


def _sql(value) -> str:
    """A value as a SQL literal."""
    if value is None:
        return "cast(null as string)"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, tuple):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@once
def _description(rules: tuple) -> tuple:
    def entry(r) -> str:
        fields = {
            "rule_id": r.rule_id,
            "prefix": r.prefix,
            "title": r.title,
            "severity": r.severity,
            "category": r.category,
            "deploy_blocking": r.blocking,
            "confidence": r.confidence,
            "problem": r.problem,
            "why": r.why,
            "steps": tuple(r.steps),
            "auto_fix": r.auto_fix,
            "prompt": r.prompt,
            "severity_rank": V.SEVERITY_RANK[r.severity],
            "detector_ord": r.detector_ord,
            "tail": r.tail,
            "rule_ord": r.rule_ord,
        }
        return "struct(" + ", ".join(f"{_sql(v)} AS {k}" for k, v in fields.items()) + ")"

    catalogue = F.expr("array(" + ", ".join(entry(r) for r in rules) + ")")
    detail = F.col("detail")

    def of(field: str, name: str | None = None) -> Column:
        return F.col(f"rule.{field}").alias(name or field)

    columns = [
        "project_id",
        finding_id(F.col("rule.prefix"), F.col("ordinal")).alias("id"),
        "rule_id",
        fill(F.col("rule.title"), detail).alias("title"),
        of("severity"),
        of("category"),
        of("deploy_blocking"),
        of("confidence"),
        "file",
        "line",
        F.lit(None).cast("int").alias("end_line"),
        F.lit(None).cast("int").alias("column"),
        F.lit(None).cast("int").alias("end_column"),
        "evidence",
        fill(F.col("rule.problem"), detail).alias("plain_english_problem"),
        of("why", "why_it_matters"),
        F.transform("rule.steps", lambda s: fill(s, detail)).alias("fix_steps"),
        of("auto_fix", "auto_fix_available"),
        of("prompt", "ai_fix_prompt"),
        F.lit(None).cast("string").alias("learn_more_url"),
        F.lit(None).cast("array<string>").alias("related_findings"),
        F.lit(None).cast("array<string>").alias("tags"),
        of("severity_rank"),
        of("detector_ord"),
        of("tail"),
        of("rule_ord"),
        "ordinal",
    ]
    return {"rule": F.get(catalogue, F.col("rule_no") - 1)}, columns


def min_severity(findings: DataFrame, level: str) -> DataFrame:
    """P3 on stored findings; a scan prunes rules at plan time instead."""
    return findings.where(severity_rank(F.col("severity")) <= V.SEVERITY_RANK[level])


def enabled_categories(findings: DataFrame, categories) -> DataFrame:
    """P1 on stored findings, one setting for all projects."""
    return findings.where(F.col("category").isin(list(categories)))


def enabled_by_project(findings: DataFrame, settings: DataFrame) -> DataFrame:
    """P1 on stored findings, each project with its own setting: ``settings(project_id,
    categories)``. A project without a row, or with null, has all categories on."""
    limited = settings.where("categories is not null")
    allowed = limited.select("project_id", F.explode_outer("categories").alias("category"))
    projects = broadcast_if_small(limited.select("project_id").distinct())
    pairs = broadcast_if_small(allowed.distinct())
    free = findings.join(projects, "project_id", "left_anti")
    return free.unionByName(findings.join(pairs, ["project_id", "category"], "left_semi"))


def find_first(findings: DataFrame, name: str) -> DataFrame:
    """Per project the first finding, in output order, with this id or rule id."""
    matching = findings.where((F.col("id") == name) | (F.col("rule_id") == name))
    best = F.min_by(F.struct(*findings.columns), order_struct()).alias("first")
    return matching.groupBy("project_id").agg(best).select("first.*")
