import pytest
from pyspark.sql import functions as F

from fleetscan import FixRegistry, ScanConfig, apply_fix, default_fixers, preview_fix, scan
from fleetscan.operators import diff, fixes
from tests.test_results import finding, table

LOG = {"rule_id": "code_quality/console-log", "auto_fix_available": True}
ENV = {"rule_id": "structure/missing-env-example", "auto_fix_available": True}
IGNORE = {"rule_id": "secret/env-not-ignored", "auto_fix_available": True}


def contents(df):
    return {(r.project_id, r.path): r.content for r in df.collect()}


def test_console_log(spark, make_files):
    files = make_files({"p": {"a.ts": "a()\n  console.log(1); console.log(2)\nconsole.log(3)\r\n"}})
    rows = table(
        spark,
        [finding(1, file="a.ts", line=2, **LOG), finding(2, file="gone.ts", line=1, **LOG),
         finding(3, file="a.ts", line=9, **LOG), finding(4, file=None, **LOG)],
    )
    text = contents(apply_fix(rows, files))[("p", "a.ts")]
    assert text == "a()\n  /* console.log */(1); /* console.log */(2)\nconsole.log(3)\r\n"
    results = {r.finding_id: r for r in fixes.fix_results(rows, files).collect()}
    assert [results[f"p-{i}"].success for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert results["p-1"].files_modified == ["a.ts"] and results["p-2"].error
    previews = {r.finding_id: r for r in preview_fix(rows, files).collect()}
    assert previews["p-1"].diff.startswith("-   console.log(1)") and previews["p-2"].diff is None


def test_many_lines_of_a_file_at_once(spark, make_files):
    text = "\n".join(f"console.log({i})" for i in range(30))
    rows = table(spark, [finding(i, file="a.ts", line=i, **LOG) for i in range(1, 31, 2)])
    fixed = contents(apply_fix(rows, make_files({"p": {"a.ts": text}})))[("p", "a.ts")].split("\n")
    assert [("/*" in line) for line in fixed] == [i % 2 == 0 for i in range(30)]


ENV_TEXT = "# note\n\nA=1\n B = x=y\nplain\n=x\nC=\nD=secret\r\n  # E=1\nF=a\rb"


def test_env_example(spark, make_files):
    files = make_files({"p": {".env": ENV_TEXT}, "q": {".env.local": "A=1"}})
    rows = table(spark, [finding(1, "p", **ENV), finding(1, "q", **ENV)])
    out = contents(apply_fix(rows, files))
    assert out[("p", ".env.example")] == "# note\n\nA=\n B =\nplain\n=x\nC=\nD=\n  # E=1\nF="
    assert ("q", ".env.example") not in out
    results = {r.project_id: r for r in fixes.fix_results(rows, files).collect()}
    assert results["p"].files_created == [".env.example"] and not results["q"].success
    strict = files.where("path = '.env'").select(fixes.example_text(F.col("content"), True)).first()[0]
    assert strict == "# note\n\nA=\n B =\nplain\n=x\nC=\nD=secret\r\n  # E=1\nF=a\rb"


def test_env_example_twice_is_once(spark, make_files):
    files = make_files({"p": {".env": ENV_TEXT}})
    rows = table(spark, [finding(1, **ENV)])
    once = apply_fix(rows, files)
    assert contents(apply_fix(rows, once)) == contents(once)


@pytest.mark.parametrize(
    "before,after",
    [
        (None, "node_modules\n.env\n.env.*\n"),
        ("", ".env\n.env.*\n"),
        ("dist", "dist\n.env\n.env.*\n"),
        ("dist\n", "dist\n.env\n.env.*\n"),
        ("dist\n .env\t\nx", "dist\n .env\t\nx"),
    ],
)
def test_gitignore(spark, make_files, before, after):
    files = make_files({"p": {"a.ts": ""} | ({} if before is None else {".gitignore": before})})
    rows = table(spark, [finding(1, **IGNORE)])
    once = apply_fix(rows, files)
    assert contents(once)[("p", ".gitignore")] == after
    assert contents(apply_fix(rows, once)) == contents(once)
    result = fixes.fix_results(rows, files).first()
    assert result.success and (result.files_created == [".gitignore"]) == (before is None)


def test_only_flagged_findings_with_a_fixer(spark):
    rows = table(
        spark,
        [finding(1, **LOG), finding(2, **(LOG | {"auto_fix_available": False})),
         finding(3, rule_id="structure/missing-gitignore", auto_fix_available=True)],
    )
    assert [r.id for r in fixes.fixable(rows).collect()] == ["p-1"]
    assert fixes.with_fixers(rows).where("fixer is null").count() == 1


def test_a_rule_has_one_fixer():
    known = default_fixers()
    with pytest.raises(ValueError, match="registered already"):
        known.register(known.all()[0])
    assert FixRegistry().get("x") is None and known.get("code_quality/console-log")


def test_fixes_hold_on_a_rescan(make_files):
    files = make_files(
        {"p": {"a.ts": "console.log(1)\nok", ".env": "A=1", "b.ts": "console.log(2)"}, "q": {"a.ts": ""}}
    )
    before = scan(files, ScanConfig(root="."))
    after = scan(apply_fix(before.findings, files), ScanConfig(root="."))
    checked = diff.verify_fixes(fixes.fixable(before.findings), after.findings).collect()
    assert len(checked) == 4 and not any(r.still_exists for r in checked)
