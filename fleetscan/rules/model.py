"""Rule declarations.

A rule is data plus a few column expressions; the scan fuses all active rules into
one projection. Three grains exist: lines, whole files, whole projects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROJECT_HIT = "struct<file:string,evidence:string,detail:string,ordinal:int>"


class FileView:
    """What a rule sees of a file. The path's classes are computed once for all rules."""

    path: Column
    content: Column
    n_lines: Column
    is_code: Column
    is_app_code: Column
    is_api_route: Column
    is_risky_route: Column
    is_admin_route: Column

    def __init__(self, **columns: Column):
        self.__dict__.update(columns)


class LineView:
    """What a rule sees of a line: its text and the text of the following line (null at the end)."""

    def __init__(self, text: Column, following: Column):
        self.text = text
        self.following = following


@dataclass(frozen=True)
class Rule:
    """Catalogue data. ``{detail}`` in a text stands for the finding's detail value."""

    rule_id: str
    category: str
    severity: str
    blocking: bool
    confidence: str
    prefix: str
    detector: str
    detector_ord: int
    rule_ord: int
    title: str
    problem: str
    why: str
    steps: tuple[str, ...]
    prompt: str | None = None
    auto_fix: bool = False
    tail: int = 0


@dataclass(frozen=True)
class LineRule(Rule):
    """Fires on lines. ``file_when`` must hold for every file with a hit; it decides
    which files are cut into lines at all, so keep it cheap and narrow.

    ``found`` gives the text the rule is about, for the catalogue's ``{detail}``. ``shows``
    says what becomes the evidence: the trimmed ``line``, the ``found`` text, or that text
    ``masked``; a masked text is masked in the detail as well.
    """

    file_when: Callable[[FileView], Column] = field(kw_only=True)
    line_when: Callable[[LineView], Column] = field(kw_only=True)
    found: Callable[[LineView], Column] | None = field(default=None, kw_only=True)
    shows: str = field(default="line", kw_only=True)


@dataclass(frozen=True)
class FileRule(Rule):
    """Fires once on a file."""

    when: Callable[[FileView], Column] = field(kw_only=True)
    lines_evidence: bool = field(default=False, kw_only=True)


@dataclass(frozen=True)
class ProjectRule(Rule):
    """Fires on a project. ``hits`` maps the project's columns to an array of
    ``file, evidence, detail, ordinal`` structs; see :func:`project_hit`."""

    hits: Callable[[Callable[[str], Column]], Column] = field(kw_only=True)


def project_hit(when: Column, file=None, evidence=None, detail=None) -> Column:
    """At most one hit, under a condition."""
    empty = F.array().cast(f"array<{PROJECT_HIT}>")
    hit = F.struct(
        (F.lit(None) if file is None else file).cast("string").alias("file"),
        (F.lit(None) if evidence is None else evidence).cast("string").alias("evidence"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
        F.lit(0).alias("ordinal"),
    )
    return F.when(when, F.array(hit).cast(f"array<{PROJECT_HIT}>")).otherwise(empty)


@dataclass(frozen=True)
class DetectorSpec:
    """A detector of one's own: a function from the selected files and the project
    contexts to rows of the findings schema."""

    id: str
    name: str
    category: str
    detect: Callable[[DataFrame, DataFrame], DataFrame]
    order: int = 100


class Registry:
    """The active rules and custom detectors of a scan, in registration order.

    ``rule_no`` of a rule is its place in :attr:`rules`, starting at 1.
    """

    def __init__(self, rules=(), detectors=()):
        self.rules: list[Rule] = list(rules)
        self.detectors: list[DetectorSpec] = list(detectors)

    def register(self, item: Rule | DetectorSpec) -> Registry:
        target = self.detectors if isinstance(item, DetectorSpec) else self.rules
        target.append(item)
        return self

    def get_detectors(self) -> list[str]:
        """Detector names in running order, each once."""
        ordered = sorted(self.rules, key=lambda r: r.detector_ord)
        names = dict.fromkeys(r.detector for r in ordered)
        return list(names) + [d.id for d in sorted(self.detectors, key=lambda d: d.order)]

    def active(self, categories=None, min_severity=None, rule_ids=None) -> Registry:
        """Plan-time pruning: rules that cannot contribute are left out of the plan."""
        from fleetscan.values import SEVERITY_RANK

        worst = SEVERITY_RANK[min_severity] if min_severity else max(SEVERITY_RANK.values())
        rules = [
            r
            for r in self.rules
            if (categories is None or r.category in categories)
            and SEVERITY_RANK[r.severity] <= worst
            and (rule_ids is None or r.rule_id in rule_ids)
        ]
        detectors = [d for d in self.detectors if categories is None or d.category in categories]
        return Registry(rules, [] if rule_ids is not None else detectors)

    def numbered(self, kind: type) -> list[tuple[int, Rule]]:
        return [(i, r) for i, r in enumerate(self.rules, 1) if isinstance(r, kind)]
