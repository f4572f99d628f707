"""Joins of contents with tables too large to be broadcast."""

import pytest
from pyspark.sql import functions as F

from fleetscan import ScanConfig, apply_fix, rescan, scan
from fleetscan.operators import fixes
from fleetscan.operators.observe import observe
from fleetscan.plans import scan as scans
from fleetscan.plans import sizing
from tests.test_plans import plan, static_plans  # noqa: F401

PLACE = ["project_id", "path"]


@pytest.fixture
def nothing_is_small(monkeypatch):
    """No table may be broadcast, hashes of keys may."""
    monkeypatch.setattr(sizing, "small", lambda df, rows=sizing.BROADCAST_ROWS, weigh=None: rows > sizing.BROADCAST_ROWS)


@pytest.fixture
def files(spark, make_files, tmp_path):
    projects = {
        f"p{i}": {"a.ts": f"console.log({i})\nok", "b.ts": "clean", ".env": "A=1"} | ({".gitignore": "x"} if i % 2 else {})
        for i in range(6)
    }
    make_files(projects).write.parquet(str(tmp_path / "files"))
    return spark.read.parquet(str(tmp_path / "files"))


def contents(df):
    return sorted((r.project_id, r.path, r.content) for r in df.collect())


def test_parts(spark, make_files, nothing_is_small):
    rows = make_files({"p": {"a": "1", "b": "2"}, "q": {"a": "3"}})
    rows = rows.unionByName(spark.createDataFrame([(None, "a", "4")], rows.schema))
    keys = make_files({"p": {"a": ""}, "r": {"b": ""}}).select(*PLACE)
    near, far = sizing.parted(rows, keys, PLACE)
    assert [r.content for r in near.collect()] == ["1"]
    assert sorted(r.content for r in far.collect()) == ["2", "3", "4"]
    assert [r.content for r in sizing.among(rows, keys, PLACE).collect()] == ["1"]


def test_a_rescan_moves_changed_contents_only(spark, files, nothing_is_small, static_plans, monkeypatch):  # noqa: F811
    tables = scan(files, ScanConfig(root="."))
    later = files.withColumn("content", F.when(F.col("path") == "b.ts", "console.log(9)").otherwise(F.col("content")))
    changed = files.where("path = 'b.ts'").select(*PLACE)
    seen = []
    monkeypatch.setattr(scans, "observe", lambda f, *a, **k: (seen.append(plan(f, "simple")), observe(f, *a, **k))[1])
    again = rescan(tables, later, changed)
    assert len(seen) == 1 and "BroadcastHashJoin [xxhash64(" in seen[0]
    found = {(r.project_id, r.file) for r in again.tables.findings.where("rule_id = 'code_quality/console-log'").collect()}
    assert found == {(f"p{i}", f) for i in range(6) for f in ("a.ts", "b.ts")}


def test_console_calls_are_looked_for_in_their_files(spark, files, nothing_is_small, static_plans):  # noqa: F811
    rows = scan(files, ScanConfig(root=".")).findings
    texts = plan(fixes._with_targets(rows.where("rule_id = 'code_quality/console-log'"), files), "simple")
    assert "BroadcastHashJoin [xxhash64(" in texts
    results = fixes.fix_results(rows, files).where("array_contains(files_modified, 'a.ts')")
    assert results.where("success").count() == 6


def test_fixes_leave_other_contents_in_place(spark, files, nothing_is_small, static_plans):  # noqa: F811
    rows = scan(files, ScanConfig(root=".")).findings
    out = apply_fix(rows, files)
    assert "BroadcastHashJoin [xxhash64(" in plan(out, "simple") and "LeftAnti" in plan(out, "simple")
    got = {(p, f): c for p, f, c in contents(out)}
    assert len(got) == len(contents(out)) == 6 * 5
    assert all(got[f"p{i}", "a.ts"] == f"/* console.log */({i})\nok" and got[f"p{i}", "b.ts"] == "clean" for i in range(6))
    assert all(got[f"p{i}", ".env.example"] == "A=" for i in range(6))
    assert got["p1", ".gitignore"] == "x\n.env\n.env.*\n" and got["p0", ".gitignore"] == "node_modules\n.env\n.env.*\n"
