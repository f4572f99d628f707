import pytest
from pyspark.sql import functions as F

from fleetscan import (
    DetectorSpec,
    FileRule,
    LineRule,
    ProjectRule,
    Registry,
    ScanConfig,
    default_registry,
    scan,
    validate_configs,
)
from fleetscan.operators.findings import FINDING_SCHEMA
from fleetscan.rules.model import project_hit

BASE = {
    "category": "code_quality", "severity": "high", "blocking": False, "confidence": "high",
    "prefix": "X", "detector": "mine", "detector_ord": 50, "title": "{detail}", "problem": "",
    "why": "", "steps": (),
}


def test_rules_of_ones_own(make_files):
    registry = Registry(
        [
            LineRule(
                rule_id="x/todo", rule_ord=0, **BASE,
                file_when=lambda f: f.content.contains("TODO"),
                line_when=lambda l: l.text.contains("TODO"),
                found=lambda l: F.regexp_extract(l.text, r"TODO\((\w+)\)", 1),
            ),
            FileRule(rule_id="x/path", rule_ord=1, **BASE, when=lambda f: f.path.startswith("tmpl/")),
        ]
    ).register(
        ProjectRule(
            rule_id="x/few", rule_ord=2, **BASE,
            hits=lambda p: project_hit(p("files_scanned") < 3, evidence=p("files_scanned")),
        )
    )
    files = make_files({"p": {"a.ts": "// TODO(ann) x\n", "tmpl/b.ts": ""}, "q": {"a.ts": ""}})
    tables = scan(files, ScanConfig(root="."), registry)
    rows = {(r.project_id, r.rule_id, r.file, r.line, r.title, r.evidence) for r in tables.findings.collect()}
    assert rows == {
        ("p", "x/todo", "a.ts", 1, "ann", "// TODO(ann) x"),
        ("p", "x/path", "tmpl/b.ts", None, "", None),
        ("p", "x/few", None, None, "", "2"),
        ("q", "x/few", None, None, "", "1"),
    }
    assert {r.project_id: r.score for r in tables.projects.collect()} == {"p": 85, "q": 95}


def test_detectors_of_ones_own(spark, make_files):
    def detect(files, context):
        named = {
            "id": F.concat(F.lit("X-"), "path"), "rule_id": F.lit("x/any"), "title": F.lit("t"),
            "severity": F.lit("critical"), "category": F.lit("secret"), "file": F.col("path"),
            "severity_rank": F.lit(0), "detector_ord": F.lit(100), "tail": F.lit(0),
            "rule_ord": F.lit(0), "ordinal": F.lit(0),
        }
        columns = []
        for c in FINDING_SCHEMA.split(", "):
            name, kind = c.split(" ", 1)
            value = F.col(name) if name == "project_id" else named.get(name, F.lit(None))
            columns.append(value.cast(kind).alias(name))
        return files.where(files.content.contains("magic")).select(*columns)

    registry = default_registry()
    registry.register(DetectorSpec("magic", "Magic", "secret", detect))
    registry.register(DetectorSpec("bad", "Bad", "secret", lambda files, context: files.select("nope")))
    files = make_files({"p": {"a.ts": "magic"}, "q": {"a.ts": ""}})
    tables = scan(files, ScanConfig(root="."), registry)
    scores = {r.project_id: (r.score, r.deploy_status, r.n_secret) for r in tables.projects.collect()}
    # Three structure findings cost 4.2 points, the detector's own one 30.
    assert scores == {"p": (66, "blocker", 1), "q": (96, "safe", 0)}
    assert tables.findings.where("rule_id = 'x/any'").count() == 1
    errors = tables.errors.collect()
    assert {(r.project_id, r.detector_id) for r in errors} == {("p", "bad"), ("q", "bad")}
    assert "magic" in registry.get_detectors()
    assert registry.active(["auth"]).detectors == []


def test_detector_order():
    assert default_registry().get_detectors() == [
        "secret-detector", "frontend-exposure-detector", "missing-auth-detector",
        "missing-validation-detector", "missing-authorization-detector", "dependency-detector",
        "codebase-mess-detector", "hardcoded-localhost-detector", "project-structure-detector",
    ]


def test_plan_time_pruning(make_files):
    files = make_files({"p": {"a.ts": "console.log(1)\ntry {} catch (e) {}"}})
    config = ScanConfig(root=".", enabled_categories=("code_quality",), min_severity="medium")
    tables = scan(files, config)
    assert [r.rule_id for r in tables.findings.collect()] == ["code_quality/empty-catch"]
    assert tables.projects.first().total == 1


def test_configuration(spark):
    assert ScanConfig.merged("x").max_files is None
    assert ScanConfig.merged("x", max_files=7).max_files == 7
    assert ScanConfig.merged("x", timeout_ms=None).timeout_ms is None
    assert ScanConfig.merged("x", min_severity=None).min_severity == "low"
    assert ScanConfig.merged("x", min_severity="high").min_severity == "high"
    with pytest.raises(ValueError, match="root.*max_files.*timeout_ms"):
        ScanConfig(root=" ", max_files=0, timeout_ms=-1).validated()
    with pytest.raises(ValueError, match="unknown"):
        ScanConfig.merged("x", colour=1)
    rows = [("a", "r", 1, 1), ("b", " ", 0, None), ("c", None, None, -5)]
    df = spark.createDataFrame(rows, "project_id string, root string, max_files int, timeout_ms int")
    errors = {r.project_id: r.error for r in validate_configs(df).collect()}
    assert errors["a"] is None and errors["b"] == "root must not be empty, max_files must be positive"
    assert "timeout_ms" in errors["c"]


def test_a_cap_is_told(make_files):
    logs = {f"f{i}.ts": "console.log(1)" for i in range(5)}
    files = make_files({"big": logs, "small": {"a.ts": ""}})
    assert scan(files, ScanConfig(root=".")).errors.count() == 0
    tables = scan(files, ScanConfig(root=".", max_files=3))
    rows = [(r.project_id, r.detector_id, r.message) for r in tables.errors.collect()]
    assert rows == [("big", "reader", "2 files beyond the cap were left out")]
    assert {r.project_id: r.files_scanned for r in tables.facts.collect()} == {"big": 3, "small": 1}


def test_ignore_prefix(make_files):
    files = make_files({"p": {"a.ts": "console.log(1) // other-disable-line\n"}})
    log = "rule_id = 'code_quality/console-log'"
    assert scan(files, ScanConfig(root=".")).findings.where(log).count() == 1
    assert scan(files, ScanConfig(root=".", ignore_prefix="other")).findings.where(log).count() == 0


def test_a_scan_with_targets(spark, make_files):
    files = make_files({"p": {"a.ts": "console.log(1)", "b.ts": "console.log(1)"}})
    targets = spark.createDataFrame([("p", "b.ts")], "project_id string, path string")
    found = scan(files, ScanConfig(root="."), targets=targets).findings.where("line is not null")
    assert [r.file for r in found.collect()] == ["b.ts"]


def _row(rows, **given):
    columns = []
    for c in FINDING_SCHEMA.split(", "):
        name, kind = c.split(" ", 1)
        value = F.col(name) if name == "project_id" else given.get(name, F.lit(0 if name in ("tail", "ordinal") else None))
        columns.append(value.cast(kind).alias(name))
    return rows.select(*columns)


def test_a_detector_that_throws_in_a_task_is_told(spark, make_files):
    def throwing(files, context):
        return _row(files, id=F.raise_error(F.lit("no\nsuch thing")).cast("string"))

    registry = default_registry()
    registry.register(DetectorSpec("throwing", "Throwing", "secret", throwing))
    files = make_files({"p": {"a.ts": "console.log(1)"}, "q": {"a.ts": ""}})
    tables = scan(files, ScanConfig(root="."), registry)
    errors = tables.errors.collect()
    assert {(r.project_id, r.detector_id) for r in errors} == {("p", "throwing"), ("q", "throwing")}
    assert all("\n" not in r.message and len(r.message) <= 500 for r in errors)
    plain = scan(files, ScanConfig(root="."))
    assert sorted(tables.findings.collect()) == sorted(plain.findings.collect())
    with pytest.raises(Exception, match="such thing"):
        scan(files, ScanConfig(root="."), registry, store=False).findings.collect()


SETTINGS = "project_id string, enabled_categories array<string>, min_severity string, exclude_patterns array<string>, max_files int"


def test_options_of_single_projects(spark, make_files):
    code = "console.log(1)\ntry {} catch (e) {}\n"
    names = ["plain", "auth", "medium", "without", "one", "bad", "strange"]
    files = make_files({p: {"a.ts": code, "b.ts": code, ".gitignore": "!b.ts"} for p in names})
    rows = [
        ("auth", ["auth"], None, None, None), ("medium", None, "medium", None, None),
        ("without", None, None, ["b.*"], None), ("one", None, None, None, 2),
        ("bad", None, None, None, -1), ("strange", ["style"], "worst", None, None),
    ]
    tables = scan(files, ScanConfig(root="."), settings=spark.createDataFrame(rows, SETTINGS))
    found = {}
    for r in tables.findings.where("category = 'code_quality'").collect():
        found.setdefault(r.project_id, []).append((r.rule_id.split("/")[1], r.file))
    both = [("console-log", "a.ts"), ("console-log", "b.ts"), ("empty-catch", "a.ts"), ("empty-catch", "b.ts")]
    assert {p: sorted(v) for p, v in found.items()} == {
        "plain": both, "medium": both[2:], "without": both[::2], "one": both[::2],
    }
    scores = {r.project_id: r.total for r in tables.projects.collect()}
    assert set(scores) == set(names) - {"bad", "strange"} and scores["auth"] == 0
    errors = {r.project_id: r.message for r in tables.errors.collect()}
    assert errors == {
        "bad": "Invalid configuration: max_files must be positive",
        "strange": "Invalid configuration: min_severity is not known, not known: style",
        "one": "1 files beyond the cap were left out",
    }
    # project rules follow the mask too
    structure = tables.findings.where("category = 'structure'").select("project_id").distinct()
    assert {r.project_id for r in structure.collect()} == {"plain", "without", "one"}


def test_options_that_are_not_given_change_nothing(spark, make_files):
    files = make_files({"p": {"a.ts": "console.log(1)"}})
    none = spark.createDataFrame([], "project_id string")
    one, other = scan(files, ScanConfig(root=".")), scan(files, ScanConfig(root="."), settings=none)
    assert one.findings.collect() == other.findings.collect() and other.errors.count() == 0
