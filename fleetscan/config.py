"""Scan options: defaults, merge and validation."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscan import values as V
from fleetscan.operators.observe import DEFAULT_IGNORE_PREFIX


_MAY_BE_NONE = ("max_files", "timeout_ms")


@dataclass(frozen=True)
class ScanConfig:
    """Options of a scan. ``max_files`` and ``timeout_ms`` may be ``None``: no cap, no limit."""

    root: str = ""
    enabled_categories: tuple[str, ...] | None = tuple(V.CATEGORIES)
    min_severity: str | None = V.DEFAULT_MIN_SEVERITY
    exclude_patterns: tuple[str, ...] = ()
    max_files: int | None = None
    timeout_ms: int | None = V.DEFAULT_TIMEOUT_MS
    ignore_prefix: str = DEFAULT_IGNORE_PREFIX
    ignore_case: bool = True

    @classmethod
    def merged(cls, root: str, **given) -> ScanConfig:
        """Defaults overlaid by the options given. A ``None`` keeps the default, but for
        ``max_files`` and ``timeout_ms``, where it asks for none."""
        known = {f.name for f in fields(cls)}
        unknown = set(given) - known
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        return replace(cls(root=root), **{k: v for k, v in given.items() if v is not None or k in _MAY_BE_NONE})

    def errors(self) -> list[str]:
        out = []
        if not self.root.strip():
            out.append("root must not be empty")
        if self.max_files is not None and self.max_files <= 0:
            out.append("max_files must be positive")
        if self.timeout_ms is not None and self.timeout_ms <= 0:
            out.append("timeout_ms must be positive")
        return out

    def validated(self) -> ScanConfig:
        """Itself, or one error naming everything that is wrong."""
        problems = self.errors()
        if problems:
            raise ValueError("Invalid configuration: " + ", ".join(problems))
        return self


SETTINGS = (
    "project_id string, root string, enabled_categories array<string>, min_severity string, "
    "exclude_patterns array<string>, max_files int, timeout_ms int"
)


def with_all_settings(configs: DataFrame) -> DataFrame:
    """``configs`` with every option of :data:`SETTINGS`; an absent one is null, which keeps the
    scan's own value."""
    given = {c.lower() for c in configs.columns}
    columns = []
    for part in SETTINGS.split(", "):
        name, kind = part.split(" ", 1)
        columns.append((F.col(name) if name in given else F.lit(None)).cast(kind).alias(name))
    return configs.select(*columns, *[c for c in configs.columns if c == "error"])


def validate_configs(configs: DataFrame) -> DataFrame:
    """Per-project options (``project_id`` and any of :data:`SETTINGS`) with a column ``error``:
    null for a usable row, otherwise everything wrong with it."""
    given = configs.columns
    problems = []
    if "root" in given:
        empty = F.coalesce(F.trim("root"), F.lit("")) == ""
        problems.append(F.when(empty, "root must not be empty"))
    for name in ("max_files", "timeout_ms"):
        if name in given:
            problems.append(F.when(F.col(name) <= 0, f"{name} must be positive"))
    if "min_severity" in given:
        known = F.col("min_severity").isin(*V.SEVERITIES)
        problems.append(F.when(~known, "min_severity is not known"))
    if "enabled_categories" in given:
        strange = F.array_except("enabled_categories", F.array(*[F.lit(c) for c in V.CATEGORIES]))
        problems.append(
            F.when(F.size(strange) > 0, F.concat(F.lit("not known: "), F.array_join(strange, " ")))
        )
    error = F.array_join(F.array_compact(F.array(*problems)), ", ") if problems else F.lit("")
    return configs.withColumn("error", F.nullif(error, F.lit("")))


def rule_mask(rules: list) -> Column:
    """Bits of the rules (bit n: rule n) that a row of settings leaves on."""
    worst = F.lit(max(V.SEVERITY_RANK.values()))
    for name, rank in V.SEVERITY_RANK.items():
        worst = F.when(F.col("min_severity") == name, rank).otherwise(worst)
    everything = F.array(*[F.lit(c) for c in V.CATEGORIES])
    chosen = F.coalesce("enabled_categories", everything)
    mask = F.lit(0).cast("bigint")
    for no, rule in enumerate(rules, 1):
        on = F.array_contains(chosen, rule.category) & (F.lit(V.SEVERITY_RANK[rule.severity]) <= worst)
        mask = mask + F.when(on, 1 << no).otherwise(0).cast("bigint")
    return mask
