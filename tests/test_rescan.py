"""A rescan of changed files against a whole scan of what there is now."""

import random

import pytest

from fleetscan import ScanConfig, rescan, scan
from fleetscan.operators.diff import merge_findings
from tests.test_plans import plan

CONTENTS = [
    "console.log(1)", "clean", "try {} catch (e) {}\nany any any", "any " * 15, "fetch('http://localhost')",
    '"use client"\nconst k = process.env.SERVICE_ROLE_KEY', "x\n" * 600,
]
MANIFESTS = ['{"scripts": {"install": "x"}}', '{"dependencies": {"next": "^1"}}', "null", "{broken", "{}"]
NAMES = ["a.ts", "src/b.tsx", "app/api/users/route.ts", "docs/c.ts", "node_modules/d.ts", "pages/e.js"]
ROOTS = {
    "package.json": MANIFESTS, "sub/package.json": MANIFESTS, ".gitignore": ["docs/", "*.ts\n.env", ".env", ""],
    ".env": ["A=1"], "README.md": ["#"], "tsconfig.json": ["{}"], "yarn.lock": ["x"],
}


def random_project(rng):
    files = {n: rng.choice(CONTENTS) for n in rng.sample(NAMES, rng.randint(0, 6))}
    return files | {n: rng.choice(v) for n, v in ROOTS.items() if rng.random() < 0.6}


def later(rng, files):
    """Some contents changed, some files added, some gone."""
    new = random_project(rng)
    return {n: new.get(n, t) if rng.random() < 0.4 else t for n, t in files.items() if rng.random() < 0.85} | {
        n: t for n, t in new.items() if n not in files and rng.random() < 0.3
    }


def results(tables):
    found = {(r.project_id, r.rule_id, r.file, r.line, r.evidence) for r in tables.findings.collect()}
    names = ["project_id", "score", "total", "files_scanned", "lines_scanned", "framework", "has_tests", "has_gitignore"]
    return found, set(tables.projects.select(*names).collect()), set(tables.errors.collect())


@pytest.mark.parametrize("max_files", [None, 2])
def test_rescans_equal_whole_scans(spark, make_files, max_files):
    rng = random.Random(11)
    now = {f"p{i}": random_project(rng) for i in range(12)}
    config = ScanConfig(root=".", max_files=max_files)
    tables = scan(make_files(now), config)
    for _ in range(2):
        new = {p: f if i % 3 == 0 else later(rng, f) for i, (p, f) in enumerate(now.items())}
        new |= {"p1": {}, f"new{rng.random()}": random_project(rng)}
        changed = [
            (p, n) for p in {*now, *new} for n in {*now.get(p, {}), *new.get(p, {})}
            if now.get(p, {}).get(n) != new.get(p, {}).get(n)
        ]
        before = tables.findings
        again = rescan(tables, make_files(new), spark.createDataFrame(changed, "project_id string, path string"))
        tables, now = again.tables, new
        assert results(tables) == results(scan(make_files(new), config))
        merged = merge_findings(before, again.partial, again.scope)
        assert sorted(r.id for r in merged.collect()) == sorted(r.id for r in tables.findings.collect())


def test_an_ignore_file_brings_back_what_it_ruled(spark, make_files):
    old = {"p": {".gitignore": "docs/", "docs/c.ts": "console.log(1)", "a.ts": "clean"}}
    new = {"p": {".gitignore": "", "docs/c.ts": "console.log(1)", "a.ts": "clean"}}
    changed = spark.createDataFrame([("p", ".gitignore")], "project_id string, path string")
    again = rescan(scan(make_files(old)), make_files(new), changed)
    assert {r.file for r in again.scope.collect()} == {".gitignore", "docs/c.ts"}
    assert results(again.tables) == results(scan(make_files(new)))


def test_rules_meet_changed_files_only(spark, make_files, tmp_path):
    files = {"p": {f"f{i}.ts": "console.log(1)" for i in range(30)}}
    make_files(files).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    changed = spark.createDataFrame([("p", "f3.ts")], "project_id string, path string")
    again = rescan(scan(files), files, changed)
    assert again.scope.count() == 1
    # whatever is read from now on comes from stored observations
    assert str(tmp_path / "files") not in plan(again.tables.findings)
