"""Project level: everything a project's files say about the project, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscan import values as V
from fleetscan.functions import paths as P
from fleetscan.functions.severity import (
    deploy_status,
    exit_code,
    penalty_tenths,
    penalty_tenths_of,
    score_from_tenths,
)
from fleetscan.operators.observe import observe
from fleetscan.plans.reuse import once
from fleetscan.rules.model import PROJECT_HIT, ProjectRule, Registry

MANIFEST = (
    "struct<scripts:map<string,string>,dependencies:map<string,string>,"
    "devDependencies:map<string,string>,engines:struct<node:string>>"
)
# As strict as the manifest format itself.
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

CONTEXT_COLUMNS = [
    "framework",
    "language",
    "has_typescript",
    "package_manager",
    "dependencies",
    "dev_dependencies",
    "scripts",
    "has_gitignore",
    "has_env_file",
    "has_env_example",
    "has_readme",
    "has_tests",
    "nextjs_version",
    "node_version",
]


def _no_map() -> Column:
    return F.create_map().cast("map<string,string>")


def _map(parsed: Column, field: str) -> Column:
    return F.coalesce(parsed[field], _no_map())


def _truthy(entries: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(entries, F.lit(key)), F.lit("")) != ""


def parse_json(text: Column, schema: str) -> Column:
    """A JSON text as strict parsers take it, or null. Read as the only element of an array,
    so that anything after the value makes the text malformed."""
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    values = F.from_json(wrapped, f"array<{schema}>", STRICT_JSON)
    return F.when(F.size(values) == 1, F.get(values, 0))


def manifest_error(text: Column, parsed: Column) -> Column:
    """Why the dependency checks cannot run on a well-formed manifest, or null."""
    scripts = F.try_element_at(parse_json(text, "map<string,string>"), F.lit("scripts"))
    # an array is told by reading the field as one: a string may begin with a bracket too
    listed = parse_json(text, "struct<scripts:array<string>>")["scripts"].isNotNull()
    scalar = scripts.isNotNull() & parsed["scripts"].isNull() & ~listed
    return F.when(F.trim(text) == "null", "the manifest is null").when(
        scalar, "the manifest's scripts are not an object"
    )


# What a row of contributions is about: the project, or one of its manifests.
CONTRIBUTION_KEY = ["project_id", "m_path", "m_selected", "manifest"]


def contributions(observations: DataFrame, registry: Registry, sign: int = 1) -> DataFrame:
    """What observation rows add to their projects: sums of a fixed width, one row for each project
    and one for each manifest in it.

    Contributions of different files add up (:func:`combined`), and ``sign=-1`` takes those of
    earlier versions away again, so a project is kept current from its changed files alone.
    Everything is hash-aggregated: the text of a manifest is a key that is null in all other
    rows, so a huge project costs one row per task in the shuffle.
    """
    keys, sums = _contribution_columns(tuple(registry.rules))
    rows = observations.withColumns(keys).groupBy(*CONTRIBUTION_KEY).agg(*[v.alias(k) for k, v in sums.items()])
    return rows if sign == 1 else rows.withColumns({k: -F.col(k) for k in sums})


def added(parts: DataFrame) -> DataFrame:
    """Contributions of several scans, rescans and withdrawals, added up; what they take away from
    parts that are not among them stays."""
    names = [c for c in parts.columns if c not in CONTRIBUTION_KEY]
    sums = parts.groupBy(*CONTRIBUTION_KEY).agg(*[F.sum(c).alias(c) for c in names])
    return sums.where("m_path is null or n_files <> 0")


def combined(parts: DataFrame) -> DataFrame:
    """The same where all parts are there: manifests that are gone leave nothing."""
    return added(parts).where("m_path is null or n_files > 0")


def project_facts(observations: DataFrame, registry: Registry) -> DataFrame:
    """One row per project: context (C1-C10), counts of file and line findings, sums."""
    return facts_of(contributions(observations, registry), registry)


def facts_of(parts: DataFrame, registry: Registry) -> DataFrame:
    """The same from contributions, at most one row for each key of them."""
    sums, flags, texts, parsed, maps, derived, dropped = _fact_columns(tuple(registry.rules))
    facts = parts.groupBy("project_id").agg(*sums, *texts).where("n_files > 0")
    facts = facts.withColumns(flags).withColumns(parsed).withColumns(maps)
    return facts.withColumns(derived).drop(*dropped)


# Files at a project's root that its context tells of.
ROOT_FILES = {
    "has_typescript": ["tsconfig.json"],
    "has_gitignore": [".gitignore", "gitignore"],
    "has_env_file": [".env", ".env.local"],
    "has_env_example": [".env.example"],
    "has_readme": ["README.md"],
    "uses_pnpm": ["pnpm-lock.yaml"],
    "uses_yarn": ["yarn.lock"],
}


@once
def _contribution_columns(rules: tuple) -> tuple[dict, dict]:
    path, is_file = F.col("path"), F.col("rule_no") == 0
    picked = is_file & F.col("selected")
    held = F.col("manifest").isNotNull()
    keys = {"m_path": F.when(held, path), "m_selected": F.when(held, F.col("selected"))}

    def total(value: Column) -> Column:
        return F.sum(value.cast("bigint"))

    sums = {"n_files": total(F.when(is_file, 1).otherwise(0))}
    for name, paths in ROOT_FILES.items():
        sums[name] = total(F.when(is_file & path.isin(*paths), 1).otherwise(0))
    sums["env_listed"] = total(F.when(is_file & F.col("env_listed"), 1).otherwise(0))
    sums["any_total"] = total(F.when(picked, F.col("any_count")).otherwise(0))
    sums["files_scanned"] = total(F.when(picked, 1).otherwise(0))
    sums["lines_scanned"] = total(F.when(picked, F.col("n_lines")).otherwise(0))
    return keys, sums | _hit_counts(rules)


@once
def _fact_columns(rules: tuple) -> tuple:
    sums = [F.sum(c).alias(c) for c in _contribution_columns(rules)[1]]
    flags = {c: F.col(c) > 0 for c in [*ROOT_FILES, "env_listed"]}
    present = (F.col("n_files") > 0) & F.col("manifest").isNotNull()
    manifest_at = F.when(present & F.col("m_selected"), F.struct(P.depth(F.col("m_path")), F.col("m_path")))
    texts = [
        F.max(F.when(present & (F.col("m_path") == "package.json"), F.col("manifest"))).alias("root_manifest"),
        F.min_by(F.struct(F.col("m_path").alias("path"), "manifest"), manifest_at).alias("first_manifest"),
    ]
    parsed = {
        "pkg": parse_json(F.col("root_manifest"), MANIFEST),
        "first_pkg": parse_json(F.col("first_manifest.manifest"), MANIFEST),
    }
    error = manifest_error(F.col("first_manifest.manifest"), F.col("first_pkg"))
    maps = {
        "dependencies": _map(F.col("pkg"), "dependencies"),
        "dev_dependencies": _map(F.col("pkg"), "devDependencies"),
        "scripts": _map(F.col("pkg"), "scripts"),
        "node_version": F.col("pkg.engines.node"),
        "manifest_path": F.col("first_manifest.path"),
        "manifest_scripts": _map(F.col("first_pkg"), "scripts"),
        "manifest_error": error,
        # A manifest that stops the dependency checks gives an error row and no findings.
        "manifest_dependency_count": F.when(error.isNotNull(), 0).otherwise(
            F.size(_map(F.col("first_pkg"), "dependencies"))
        ),
    }
    deps, dev = F.col("dependencies"), F.col("dev_dependencies")
    runners = F.array(*[F.lit(r) for r in V.TEST_RUNNERS])
    derived = {
        "framework": F.when(_truthy(deps, "next"), "nextjs")
        .when(_truthy(dev, "vite") | _truthy(deps, "vite"), "vite")
        .when(_truthy(deps, "express"), "express")
        .otherwise("unknown"),
        "language": F.when(F.col("has_typescript"), "typescript").otherwise("javascript"),
        "package_manager": F.when(F.col("uses_pnpm"), "pnpm")
        .when(F.col("uses_yarn"), "yarn")
        .otherwise("npm"),
        "has_tests": F.arrays_overlap(F.map_keys(dev), runners)
        | F.exists(F.map_keys("scripts"), lambda k: k.contains("test")),
        "nextjs_version": F.regexp_replace(F.try_element_at(deps, F.lit("next")), r"[\^~]", ""),
    }
    dropped = ["pkg", "first_pkg", "first_manifest", "root_manifest", "uses_pnpm", "uses_yarn", "n_files"]
    return sums, flags, texts, parsed, maps, derived, dropped


def project_context(raw_files: DataFrame) -> DataFrame:
    """C1-C10 for a listing of all files, selected or not."""
    observations = observe(raw_files, Registry())
    return project_facts(observations, Registry()).select("project_id", *CONTEXT_COLUMNS)


def _hit_counts(rules: tuple) -> dict[str, Column]:
    """Findings per severity and category and their penalty, from rule numbers alone."""
    numbered = [(no, r) for no, r in enumerate(rules, 1) if not isinstance(r, ProjectRule)]

    def tally(value_of) -> Column:
        cases = {no: value_of(r) for no, r in numbered if value_of(r)}
        value = F.lit(0)
        for weight in sorted(set(cases.values())):
            numbers = [no for no, w in cases.items() if w == weight]
            value = F.when(F.col("rule_no").isin(numbers), weight).otherwise(value)
        return F.sum(value.cast("bigint"))

    out = {"file_penalty": tally(lambda r: penalty_tenths_of(r.severity, r.category))}
    for s in V.SEVERITIES:
        out[f"file_{s}"] = tally(lambda r, s=s: int(r.severity == s))
    for c in V.CATEGORIES:
        out[f"file_{c}"] = tally(lambda r, c=c: int(r.category == c))
    return out


def with_project_hits(facts: DataFrame, registry: Registry) -> DataFrame:
    """Evaluate the project rules: column ``hits_<no>`` holds a rule's hits. Where facts have a
    column ``active``, its bits say which rules run."""
    hits = _project_hits(tuple(registry.rules), "active" in facts.columns)
    return facts.withColumns(hits) if hits else facts


@once
def _project_hits(rules: tuple, masked: bool) -> dict[str, Column]:
    def hits(no: int, rule: ProjectRule) -> Column:
        if not masked:
            return rule.hits(F.col)
        none = F.array().cast(f"array<{PROJECT_HIT}>")
        return F.when(F.getbit("active", F.lit(no)) == 1, rule.hits(F.col)).otherwise(none)

    return {f"hits_{no}": hits(no, r) for no, r in Registry(rules).numbered(ProjectRule)}


def project_summary(facts: DataFrame, registry: Registry) -> DataFrame:
    """A1-A3 without touching single findings: file-level sums plus project-level hits."""
    totals, dropped = _summary_columns(tuple(registry.rules))
    rows = with_project_hits(facts, registry).withColumns(totals).drop(*dropped)
    return _scored(rows)


@once
def _summary_columns(all_rules: tuple) -> tuple:
    rules = Registry(all_rules).numbered(ProjectRule)

    def total(base: str, value_of) -> Column:
        out = F.col(base)
        for no, r in rules:
            if value_of(r):
                out = out + F.size(f"hits_{no}") * F.lit(value_of(r))
        return out.cast("bigint")

    totals = {
        "penalty_tenths": total("file_penalty", lambda r: penalty_tenths_of(r.severity, r.category))
    }
    for s in V.SEVERITIES:
        totals[f"n_{s}"] = total(f"file_{s}", lambda r, s=s: int(r.severity == s))
    for c in V.CATEGORIES:
        totals[f"n_{c}"] = total(f"file_{c}", lambda r, c=c: int(r.category == c))
    dropped = [f"hits_{no}" for no, _ in rules] + ["file_penalty"]
    dropped += [f"file_{x}" for x in V.SEVERITIES + V.CATEGORIES]
    return totals, dropped


@once
def _score_columns() -> tuple:
    counts = F.create_map(*[x for c in V.CATEGORIES for x in (F.lit(c), F.col(f"n_{c}"))])
    return (
        {"score": score_from_tenths(F.col("penalty_tenths"))},
        {"deploy_status": deploy_status(F.col("score"), F.col("n_critical") > 0)},
        {
            "total": sum((F.col(f"n_{s}") for s in V.SEVERITIES[1:]), F.col("n_critical")),
            "exit_code": exit_code(F.col("deploy_status")),
            "category_counts": counts,
        },
    )


def _scored(rows: DataFrame) -> DataFrame:
    """Score, status and totals from the penalty and the counts."""
    for columns in _score_columns():
        rows = rows.withColumns(columns)
    return rows


def add_findings(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """Count further findings into rows of :func:`project_summary`."""
    numbers = {
        "penalty_tenths": F.sum(penalty_tenths(F.col("severity"), F.col("category"))),
        **{f"n_{s}": F.count_if(F.col("severity") == s) for s in V.SEVERITIES},
        **{f"n_{c}": F.count_if(F.col("category") == c) for c in V.CATEGORIES},
    }
    sums = findings.groupBy("project_id").agg(*[v.alias(f"add_{k}") for k, v in numbers.items()])
    rows = projects.join(sums, "project_id", "left")
    rows = rows.withColumns(
        {k: F.col(k) + F.coalesce(f"add_{k}", F.lit(0)) for k in numbers}
    )
    return _scored(rows).drop(*[f"add_{k}" for k in numbers])
