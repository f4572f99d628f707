"""The fused rule projection: one narrow pass over the file contents.

``observe`` yields, for every file, one *file row* (``rule_no = 0``) with what the
project level needs to know about the file, and one row per rule hit. Contents do
not leave this stage: whatever follows moves paths, numbers and single lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscan.functions import paths as P
from fleetscan.functions.text import any_of, count_word, line_count, redact, split_lines, strip
from fleetscan.plans.reuse import once
from fleetscan.rules.model import FileRule, FileView, LineRule, LineView, Registry
from fleetscan.values import TRIM_CHARS

DEFAULT_IGNORE_PREFIX = "fleetscan"

# A line that is exactly ".env" once trimmed.
_WS = "[" + TRIM_CHARS + "]*"
ENV_LINE = rf"(?:^|\n){_WS}\.env{_WS}(?:\n|\z)"


def observe(
    files: DataFrame,
    registry: Registry,
    ignore_prefix: str = DEFAULT_IGNORE_PREFIX,
    honour_ignores: bool = True,
) -> DataFrame:
    """``files(project_id, path, content[, selected])`` to observation rows.

    Files with ``selected = false`` only give their file row. Inline ignore comments
    take effect here, where the lines are at hand; ``honour_ignores=False`` leaves
    all hits in, for :func:`fleetscan.operators.suppress.inline_ignores` to filter. A column
    ``active`` says by its bits which rules run on the file (bit n: rule n).
    """
    if "selected" not in files.columns:
        files = files.withColumn("selected", F.lit(True))
    masked = "active" in files.columns
    for columns in _stages(tuple(registry.rules), ignore_prefix, honour_ignores, masked):
        files = files.select(*columns)
    return files


@once
def _stages(
    rules: tuple, ignore_prefix: str, honour_ignores: bool, masked: bool
) -> tuple[list, ...]:
    """The projections of :func:`observe`, in order."""
    registry = Registry(rules)
    line_rules = registry.numbered(LineRule)
    file_rules = registry.numbered(FileRule)

    path, content, selected = F.col("path"), F.col("content"), F.col("selected")
    classes = {
        "is_code": P.is_code(path),
        "is_app_code": P.is_app_code(path),
        "is_api_route": P.is_api_route(path),
        "is_risky_route": P.is_risky_route(path),
        "is_admin_route": P.is_admin_route(path),
    }
    classified = [
        "project_id",
        "path",
        "selected",
        F.coalesce("content", F.lit("")).alias("content"),
        *[when.alias(name) for name, when in classes.items()],
        *(["active"] if masked else []),
    ]
    none = F.array().cast("array<int>")

    def fires(no: int, when: Column) -> Column:
        return F.when(when, F.array(F.lit(no))).otherwise(none)

    def runs(no: int, when: Column) -> Column:
        return (F.getbit("active", F.lit(no)) == 1) & when if masked else when

    n_lines = line_count(content)
    view = FileView(path=path, content=content, n_lines=n_lines, **{c: F.col(c) for c in classes})
    per_file = [
        "project_id",
        "path",
        "selected",
        "content",
        *[(selected & runs(no, r.file_when(view))).alias(f"look_{no}") for no, r in line_rules],
        F.when(
            selected,
            F.concat(F.array(F.lit(0)), *[fires(no, runs(no, r.when(view))) for no, r in file_rules]),
        )
        .otherwise(F.array(F.lit(0)))
        .alias("file_hits"),
        F.when(selected, n_lines).otherwise(0).alias("n_lines"),
        F.when(selected & F.col("is_code"), count_word(content, "any"))
        .otherwise(0)
        .cast("int")
        .alias("any_count"),
        F.when(P.is_manifest(path), content).alias("manifest"),
        ((path == ".gitignore") & content.rlike(ENV_LINE)).alias("env_listed"),
        content.contains(f"{ignore_prefix}-disable").alias("has_ignores"),
        content.contains(f"{ignore_prefix}-disable-file").alias("ignores_file"),
    ]

    look = any_of(F.col(f"look_{no}") for no, _ in line_rules)
    lines = F.when(look, split_lines(F.col("content"))).otherwise(F.array().cast("array<string>"))
    keep = ["project_id", "path", "selected", "n_lines", "any_count", "manifest", "env_listed"]
    flags = ["file_hits", "has_ignores", "ignores_file", *[f"look_{no}" for no, _ in line_rules]]
    # Element 0 stands for the file itself, element n for line n. The outer form gives the
    # same rows here, as the array is never empty; the plain form would make the optimizer
    # add a filter on the array's size and so cut every file into lines twice.
    with_lines = [
        *keep, *flags, F.concat(F.array(F.lit(None).cast("string")), lines).alias("lines")
    ]
    per_line = [*keep, *flags, "lines", F.posexplode_outer("lines").alias("line", "text")]

    line_view = LineView(F.col("text"), F.get("lines", F.col("line") + 1))
    hits = F.concat(
        none, *[fires(no, F.col(f"look_{no}") & r.line_when(line_view)) for no, r in line_rules]
    )
    if honour_ignores:
        muted = F.col("ignores_file") | ignored_line(
            line_view.text, F.get("lines", F.col("line") - 1), ignore_prefix
        )
        hits = F.when(F.col("has_ignores") & muted, none).otherwise(hits)
    per_hit = [
        *keep,
        "lines",
        "line",
        "text",
        F.explode(F.when(F.col("line") == 0, F.col("file_hits")).otherwise(hits)).alias("rule_no"),
    ]

    # The found text first and what is made of it after, so that each pattern runs once per
    # hit and the generated code stays small enough to be compiled.
    found = [
        *[(no, r.found(line_view)) for no, r in line_rules if r.found],
        *[(no, F.col("n_lines").cast("string")) for no, r in file_rules if r.lines_evidence],
    ]
    with_found = [*keep, "line", "text", "rule_no", _by_rule(found).alias("found")]
    rule_no = F.col("rule_no")
    masked = rule_no.isin([no for no, r in line_rules if r.shows == "masked"])
    shown = rule_no.isin([no for no, r in line_rules if r.shows == "found"])
    counted = rule_no.isin([no for no, r in file_rules if r.lines_evidence])
    detail = F.when(masked, redact(F.col("found"))).otherwise(F.col("found"))
    result = [
        "project_id",
        "path",
        "selected",
        "rule_no",
        "line",
        F.when(counted, F.concat("found", F.lit(" lines")))
        .when(masked | shown, detail)
        .when(rule_no > 0, strip(F.col("text")))
        .alias("evidence"),
        detail.alias("detail"),
        "n_lines",
        "any_count",
        F.when(rule_no == 0, F.col("manifest")).alias("manifest"),
        "env_listed",
    ]
    return classified, per_file, with_lines, per_line, per_hit, with_found, result


def ignored_line(text: Column, previous: Column, prefix: str) -> Column:
    """An ignore comment on the line itself or, for the next line, on the one before."""
    here = text.contains(f"{prefix}-disable-line")
    before = previous.contains(f"{prefix}-disable-next-line")
    return F.coalesce(here, F.lit(False)) | F.coalesce(before, F.lit(False))


def _by_rule(values: list[tuple[int, Column]]) -> Column:
    """The value that goes with the row's rule number, or null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for no, value in values:
        out = out.when(F.col("rule_no") == no, value)
    return out.otherwise(F.lit(None).cast("string"))
