"""Code-safety analytics over fleets of projects, as Spark jobs."""

from fleetscan.config import ScanConfig, validate_configs
from fleetscan.operators.context import project_context, project_summary
from fleetscan.operators.fixes import FixRegistry, FixSpec, apply_fix, default_fixers, preview_fix
from fleetscan.operators.repair import repair_plan, repair_steps
from fleetscan.operators.scoring import score, summary
from fleetscan.plans.scan import Rescan, ScanTables, rescan, scan
from fleetscan.rules.builtin import BUILTIN_RULES, default_registry
from fleetscan.rules.model import DetectorSpec, FileRule, LineRule, ProjectRule, Registry
from fleetscan.sources.corpus import read_corpus
from fleetscan.sources.trees import decode, read_trees
from fleetscan.streaming.saves import IncrementalScan, SessionLog, debounce

__all__ = [
    "BUILTIN_RULES",
    "DetectorSpec",
    "FileRule",
    "FixRegistry",
    "FixSpec",
    "IncrementalScan",
    "LineRule",
    "ProjectRule",
    "Registry",
    "Rescan",
    "ScanConfig",
    "ScanTables",
    "SessionLog",
    "apply_fix",
    "debounce",
    "decode",
    "default_fixers",
    "default_registry",
    "preview_fix",
    "project_context",
    "project_summary",
    "read_corpus",
    "read_trees",
    "repair_plan",
    "repair_steps",
    "rescan",
    "scan",
    "score",
    "summary",
    "validate_configs",
]
