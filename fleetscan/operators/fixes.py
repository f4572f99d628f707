"""Automatic fixes as transforms of the file table. Nothing is changed in place: a fix
yields new contents, a preview or a result row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscan import values as V
from fleetscan.functions.text import split_lines, strip
from fleetscan.plans.sizing import broadcast_if_small, parted, small_side, stored

RESULT_COLUMNS = [
    "project_id", "finding_id", "success", "files_modified", "files_created", "message", "error",
]
PREVIEW_COLUMNS = [
    "project_id", "finding_id", "description", "files_to_modify", "files_to_create", "diff",
]


@dataclass(frozen=True)
class FixSpec:
    """A fixer for one rule.

    ``contents(findings, files)`` gives ``project_id, path, new_content`` of the files it
    writes; ``preview`` and ``result`` give rows for :data:`PREVIEW_COLUMNS` and
    :data:`RESULT_COLUMNS`.
    """

    rule_id: str
    description: str
    contents: Callable[[DataFrame, DataFrame], DataFrame]
    preview: Callable[[DataFrame, DataFrame], DataFrame]
    result: Callable[[DataFrame, DataFrame], DataFrame]


class FixRegistry:
    """Fixers by rule; a rule has at most one."""

    def __init__(self, fixers=()):
        self._fixers: dict[str, FixSpec] = {}
        for f in fixers:
            self.register(f)

    def register(self, fixer: FixSpec) -> FixRegistry:
        if fixer.rule_id in self._fixers:
            raise ValueError(f"a fixer for {fixer.rule_id} is registered already")
        self._fixers[fixer.rule_id] = fixer
        return self

    def get(self, rule_id: str) -> FixSpec | None:
        return self._fixers.get(rule_id)

    def all(self) -> list[FixSpec]:
        return list(self._fixers.values())


BLOCK = 128


# --- console.log --------------------------------------------------------------------


def comment_calls(line: Column) -> Column:
    return F.replace(line, F.lit(V.CALL_TO_COMMENT), F.lit(V.COMMENTED_CALL))


def _with_files(findings: DataFrame, files: DataFrame, path: Column) -> DataFrame:
    """Findings with the content of ``path`` in their project; null where there is no such file."""
    texts = files.select("project_id", F.col("path").alias("at"), "content")
    rows = findings.withColumn("at", path)
    return rows.join(texts, ["project_id", "at"], "left")


def _targets(findings: DataFrame) -> DataFrame:
    """``project_id, path, targets``: the lines to change in each file. They are kept by blocks
    of ``BLOCK`` lines, so that asking for a line looks at one block only."""
    located = findings.where("file is not null and line is not null")
    block = F.floor(F.col("line") / BLOCK).cast("int").alias("block")
    blocks = located.groupBy("project_id", F.col("file").alias("path"), block).agg(
        F.collect_set("line").alias("in_block")
    )
    none = F.array().cast("array<int>")
    by_block = F.map_from_entries(F.collect_list(F.struct("block", "in_block")))
    files = blocks.groupBy("project_id", "path").agg(
        by_block.alias("by_block"), F.max("block").alias("last"), F.sum(F.size("in_block")).alias("n")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.col("last")),
        lambda b: F.coalesce(F.try_element_at("by_block", b), none),
    )
    return files.select("project_id", "path", dense.alias("targets"), "n")


def _is_target(line: Column) -> Column:
    block = F.get("targets", F.floor(line / BLOCK).cast("int"))
    return F.coalesce(F.array_contains(block, line), F.lit(False))


def _with_targets(findings: DataFrame, files: DataFrame) -> DataFrame:
    place, n = ["project_id", "path"], F.col("n")
    targets = small_side(_targets(findings), weigh=n)
    texts, _ = parted(files.select(*place, "content"), targets, place, weigh=n)
    return texts.join(targets, place)


def _console_log_contents(findings: DataFrame, files: DataFrame) -> DataFrame:
    """All findings of a file take effect at once; line numbers do not change."""
    fixed = F.transform(
        split_lines(F.col("content")),
        lambda text, i: F.when(_is_target(i + 1), comment_calls(text)).otherwise(text),
    )
    rows = _with_targets(findings, files)
    return rows.select("project_id", "path", F.array_join(fixed, "\n").alias("new_content"))


def _console_log_rows(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with the line they are about. Each file is cut into lines once, whatever the
    number of its findings; line 0 says that the file is there."""
    lines = F.concat(F.array(F.lit(None).cast("string")), split_lines(F.col("content")))
    places = _with_targets(findings, files).select(
        "project_id",
        F.col("path").alias("file"),
        "targets",
        F.posexplode_outer(lines).alias("line", "old"),
    )
    places = stored(
        places.where((F.col("line") == 0) | _is_target(F.col("line"))).drop("targets")
    )
    present = places.where("line = 0").select("project_id", "file", F.lit(True).alias("present"))
    rows = findings.join(places.where("line > 0"), ["project_id", "file", "line"], "left")
    rows = rows.join(present, ["project_id", "file"], "left")
    located = F.col("file").isNotNull() & F.col("line").isNotNull()
    return rows.withColumn("located", located)


def _console_log_preview(findings: DataFrame, files: DataFrame) -> DataFrame:
    rows = _console_log_rows(findings, files)
    found = F.col("old").isNotNull()
    description = (
        F.when(~F.col("located"), "The finding has no file or line.")
        .when(F.col("present").isNull(), "The file cannot be read.")
        .when(~found, "There is no such line.")
        .otherwise(F.format_string("Line %2$d of %1$s: its logging calls become comments", "file", "line"))
    )
    diff = F.concat(F.lit("- "), F.col("old"), F.lit("\n+ "), comment_calls(F.col("old")))
    return _preview(
        rows, description, F.when(found, F.array("file")), None, F.when(found, diff)
    )


def _console_log_result(findings: DataFrame, files: DataFrame) -> DataFrame:
    rows = _console_log_rows(findings, files)
    found = F.col("old").isNotNull()
    message = (
        F.when(~F.col("located"), "The finding has no place.")
        .when(F.col("present").isNull(), "The fix could not be applied.")
        .when(~found, "There is no such line.")
        .otherwise(F.format_string("The logging calls of line %d are comments now.", "line"))
    )
    error = F.when(F.col("located") & F.col("present").isNull(), "The file cannot be read.")
    return _result(rows, found, F.when(found, F.array("file")), None, message, error)


# --- .env.example ------------------------------------------------------------------


def example_text(content: Column, keep_cr_values: bool = False) -> Column:
    """Environment text without values. Comments, blank and other lines stay.

    A carriage return before the line feed counts as part of the line end, so values of such
    lines go too; ``keep_cr_values=True`` keeps those lines as they are.
    """

    def one(line: Column) -> Column:
        text = strip(line)
        key = F.regexp_extract(line, "^([^=]+)=", 1)
        drop = key != ""
        if keep_cr_values:
            drop = drop & ~F.substr(line, F.length(key) + 2).rlike(r"[\r\u2028\u2029]")
        kept = (text == "") | text.startswith("#")
        return F.when(drop & ~kept, F.concat(key, F.lit("="))).otherwise(line)

    return F.array_join(F.transform(split_lines(content), one), "\n")


def _env_rows(findings: DataFrame, files: DataFrame) -> DataFrame:
    env = files.where(F.col("path") == ".env")
    return _with_files(findings, env, F.lit(".env"))


def _env_example_contents(findings: DataFrame, files: DataFrame) -> DataFrame:
    projects = broadcast_if_small(findings.select("project_id").distinct())
    env = files.where(F.col("path") == ".env").join(projects, "project_id", "left_semi")
    return env.select(
        "project_id",
        F.lit(".env.example").alias("path"),
        example_text(F.col("content")).alias("new_content"),
    )


def _env_example_preview(findings: DataFrame, files: DataFrame) -> DataFrame:
    rows = _env_rows(findings, files)
    found = F.col("content").isNotNull()
    added = F.replace(example_text(F.col("content")), F.lit("\n"), F.lit("\n+ "))
    description = F.when(found, "Create .env.example from .env without its values.").otherwise(
        "There is no .env to start from."
    )
    return _preview(
        rows,
        description,
        None,
        F.when(found, F.array(F.lit(".env.example"))),
        F.when(found, F.concat(F.lit("+ "), added)),
    )


def _env_example_result(findings: DataFrame, files: DataFrame) -> DataFrame:
    rows = _env_rows(findings, files)
    found = F.col("content").isNotNull()
    message = F.when(found, "Created .env.example.").otherwise("Could not create .env.example.")
    error = F.when(~found, "There is no .env.")
    return _result(
        rows, found, None, F.when(found, F.array(F.lit(".env.example"))), message, error
    )


# --- .gitignore --------------------------------------------------------------------------


def _lists_env(content: Column) -> Column:
    return F.exists(split_lines(content), lambda line: strip(line) == ".env")


def _gitignore_rows(findings: DataFrame, files: DataFrame) -> DataFrame:
    ignore = files.where(F.col("path") == ".gitignore")
    return _with_files(findings, ignore, F.lit(".gitignore"))


def gitignore_text(content: Column) -> Column:
    """The text after the fix; null stands for "no file"."""
    gap = F.when((content == "") | content.endswith("\n"), "").otherwise("\n")
    return (
        F.when(content.isNull(), V.NEW_GITIGNORE)
        .when(_lists_env(content), content)
        .otherwise(F.concat(content, gap, F.lit(V.GITIGNORE_ADDITION)))
    )


def _gitignore_contents(findings: DataFrame, files: DataFrame) -> DataFrame:
    rows = _gitignore_rows(findings.select("project_id").distinct(), files)
    changed = F.col("content").isNull() | ~_lists_env(F.col("content"))
    return rows.where(changed).select(
        "project_id",
        F.lit(".gitignore").alias("path"),
        gitignore_text(F.col("content")).alias("new_content"),
    )


def _gitignore_files(rows: DataFrame) -> tuple[Column, Column]:
    exists = F.col("content").isNotNull()
    one = F.array(F.lit(".gitignore"))
    return F.when(exists, one), F.when(~exists, one)


def _gitignore_preview(findings: DataFrame, files: DataFrame) -> DataFrame:
    rows = _gitignore_rows(findings, files)
    modify, create = _gitignore_files(rows)
    diff = F.when(F.col("content").isNotNull(), "+ .env\n+ .env.*\n").otherwise(
        "New .gitignore:\n" + V.NEW_GITIGNORE
    )
    description = F.lit("Add `.env` and `.env.*` to .gitignore.")
    return _preview(rows, description, modify, create, diff)


def _gitignore_result(findings: DataFrame, files: DataFrame) -> DataFrame:
    rows = _gitignore_rows(findings, files)
    modified, created = _gitignore_files(rows)
    message = (
        F.when(F.col("content").isNull(), "Created .gitignore with `.env`.")
        .when(_lists_env(F.col("content")), ".gitignore listed .env already.")
        .otherwise("Added `.env` to .gitignore.")
    )
    return _result(rows, F.lit(True), modified, created, message, None)


def _preview(rows, description, modify, create, diff) -> DataFrame:
    return rows.select(
        "project_id",
        F.col("id").alias("finding_id"),
        description.alias("description"),
        _paths(modify).alias("files_to_modify"),
        _paths(create).alias("files_to_create"),
        diff.cast("string").alias("diff"),
    )


def _result(rows, success, modified, created, message, error) -> DataFrame:
    return rows.select(
        "project_id",
        F.col("id").alias("finding_id"),
        success.alias("success"),
        _paths(modified).alias("files_modified"),
        _paths(created).alias("files_created"),
        message.alias("message"),
        (F.lit(None) if error is None else error).cast("string").alias("error"),
    )


def _paths(col: Column | None) -> Column:
    empty = F.array().cast("array<string>")
    return empty if col is None else F.coalesce(col, empty)


def default_fixers() -> FixRegistry:
    return FixRegistry(
        [
            FixSpec(
                "secret/env-not-ignored",
                "Adds .env to .gitignore.",
                _gitignore_contents,
                _gitignore_preview,
                _gitignore_result,
            ),
            FixSpec(
                "structure/missing-env-example",
                "Creates .env.example from .env, without values.",
                _env_example_contents,
                _env_example_preview,
                _env_example_result,
            ),
            FixSpec(
                "code_quality/console-log",
                "Comments out console.log.",
                _console_log_contents,
                _console_log_preview,
                _console_log_result,
            ),
        ]
    )


# --- applying fixes ---------------------------------------------------------------------------


def with_fixers(findings: DataFrame, fixers: FixRegistry | None = None) -> DataFrame:
    """Every finding with its fixer's description, null where no fixer is registered.
    The fixer table is a handful of literals, so the join is a broadcast by construction."""
    fixers = fixers or default_fixers()
    table = F.array(
        *[
            F.struct(F.lit(f.rule_id).alias("rule_id"), F.lit(f.description).alias("fixer"))
            for f in fixers.all()
        ]
    )
    rows = findings.sparkSession.range(1).select(F.inline(table))
    return findings.join(F.broadcast(rows), "rule_id", "left")


def fixable(findings: DataFrame, fixers: FixRegistry | None = None) -> DataFrame:
    """Findings flagged as fixable whose rule has a fixer."""
    rows = with_fixers(findings.where("auto_fix_available"), fixers)
    return rows.where("fixer is not null").drop("fixer").select(*findings.columns)


def _each(findings: DataFrame, fixers: FixRegistry | None, part):
    chosen = fixable(findings, fixers)
    out = None
    for f in (fixers or default_fixers()).all():
        rows = part(f)(chosen.where(F.col("rule_id") == f.rule_id))
        out = rows if out is None else out.unionByName(rows)
    return out


def fixed_files(findings: DataFrame, files: DataFrame, fixers: FixRegistry | None = None):
    """``project_id, path, new_content`` of every file the fixes write."""
    return _each(findings, fixers, lambda f: lambda rows: f.contents(rows, files))


def preview_fix(findings: DataFrame, files: DataFrame, fixers: FixRegistry | None = None):
    """What each fix would do."""
    return _each(findings, fixers, lambda f: lambda rows: f.preview(rows, files))


def fix_results(findings: DataFrame, files: DataFrame, fixers: FixRegistry | None = None):
    """The outcome of each fix."""
    return _each(findings, fixers, lambda f: lambda rows: f.result(rows, files))


def apply_fix(findings: DataFrame, files: DataFrame, fixers: FixRegistry | None = None):
    """The file table after all fixes: changed contents and added files."""
    # worked out once, and sent to where the files are if it measures small: then no content moves;
    # otherwise those move that may be changed
    fixed = small_side(fixed_files(findings, files, fixers), weigh=F.length("new_content"))
    return with_fixes(files, fixed)


def with_fixes(files: DataFrame, fixed: DataFrame) -> DataFrame:
    """``files`` with the contents of ``fixed(project_id, path, new_content)`` put in."""
    place = ["project_id", "path"]
    near, far = parted(files.select(*place, "content"), fixed, place, weigh=F.length("new_content"))
    out = near.join(fixed, place, "left")
    kept = out.select(*place, F.coalesce("new_content", "content").alias("content"))
    if far is not None:
        kept = kept.unionByName(far)
    known = files.where(F.col("path").isin(".env.example", ".gitignore"))
    added = fixed.where(F.col("path").isin(".env.example", ".gitignore")).join(
        known.select("project_id", "path"), ["project_id", "path"], "left_anti"
    )
    return kept.unionByName(
        added.select("project_id", "path", F.col("new_content").alias("content"))
    )
