import fnmatch

import pytest
from pyspark.sql import functions as F

from fleetscan.operators import gitignore, selection


def paths(df):
    return {r.path for r in df.select("path").collect()}


def test_names_extensions_and_directories(make_files):
    kept = [
        "a.ts", "a.b.tsx", "x/a.js", "a.jsx", "a.mjs", "a.cjs", "a.json", ".env", "x/.env.local",
        ".gitignore", "yarn.lock", "pnpm-lock.yaml", "distant/a.ts", "x/out.ts", "..ts",
    ]
    dropped = [
        "a.md", ".ts", "x/.js", "README", "a.tsx.bak", "node_modules/a.ts", "x/dist/a.ts",
        ".git/a.json", "a/.next/b/c.js", "Build/a.ts", "poetry.lock",
    ]
    files = make_files({"p": {p: "" for p in kept + dropped}})
    assert paths(selection.select_files(files)) == set(kept)


GIT_CASES = [
    # rules, path, ignored
    ("*.log", "a.log", True),
    ("*.log", "x/y/a.log", True),
    ("*.log\n!keep.log", "x/keep.log", False),
    ("!keep.log\n*.log", "keep.log", True),
    ("docs/", "docs/a.ts", True),
    ("docs/", "x/docs/a.ts", True),
    ("docs/", "docs", False),
    ("/docs", "docs/a.ts", True),
    ("/docs", "x/docs/a.ts", False),
    ("a/b", "a/b/c.ts", True),
    ("a/b", "x/a/b/c.ts", False),
    ("vendor/\n!vendor/keep.ts", "vendor/keep.ts", True),
    ("vendor/*\n!vendor/keep.ts", "vendor/keep.ts", False),
    ("vendor/*\n!vendor/keep.ts", "vendor/drop.ts", True),
    ("**/gen/*.ts", "gen/a.ts", True),
    ("**/gen/*.ts", "x/y/gen/a.ts", True),
    ("**/gen/*.ts", "x/gen/y/a.ts", False),
    ("a/**/z.ts", "a/z.ts", True),
    ("a/**/z.ts", "a/b/c/z.ts", True),
    ("a/**", "a/b/c.ts", True),
    ("a/**", "a", False),
    ("fo?.ts", "foo.ts", True),
    ("fo?.ts", "fo/.ts", False),
    ("f[ab].ts", "fa.ts", True),
    ("f[!ab].ts", "fa.ts", False),
    ("f[!ab].ts", "fc.ts", True),
    ("# a.ts", "a.ts", False),
    (r"\#a.ts", "#a.ts", True),
    (r"\!a.ts", "!a.ts", True),
    ("a.ts   ", "a.ts", True),
    ("a.ts\r", "a.ts", True),
    ("A.TS", "a.ts", True),
    ("a+b.ts", "a+b.ts", True),
    ("a.ts", "aXts", False),
    (r"a\*.ts", "a*.ts", True),
    (r"a\*.ts", "ab.ts", False),
    ("", "a.ts", False),
    # lines that are cut short, run backwards or mean nothing: none stops the scan
    ("foo[", "foo[", True),
    ("foo[", "foo", False),
    ("[z-a].ts", "b.ts", False),
    ("[^z-a].ts", "b.ts", True),
    ("x\\", "x", True),
    ("[[:alpha:]].ts", "a.ts", True),
    ("[[:alpha:]].ts", "1.ts", False),
    ("[[:digit:]x].ts", "1.ts", True),
    ("[[:nope:]].ts", "a.ts", False),
    ("[[:upper:]].ts", "a.ts", True),
    ("[!a]", "a", False),
    ("[!a]", "b", True),
    ("a[!b]c", "a/c", False),
    ("a{b", "a{b", True),
    ("a(b|", "a(b|", True),
    ("[]a].ts", "].ts", True),
    ("[a&&b].ts", "&.ts", True),
    ("[a[b].ts", "[.ts", True),
    ("[a\\]].ts", "].ts", True),
    ("[+--].ts", ",.ts", True),
    ("*[", "a[", True),
    ("a/**/**/z.ts", "a/z.ts", True),
    ("# only\n# comments\n\n", "a.ts", False),
    ("foo[\n*.ts", "a.ts", True),
    # wildcards that take the first place, and may not take too much
    ("a*b*b", "abb", True),
    ("a*b*b", "ab", False),
    ("*ab", "aab", True),
    ("*ab*ab", "abab", True),
    ("*ab*ab", "aab", False),
    ("a*", "a/b", True),
    ("x*/y", "xz/y", True),
    ("x*/y", "x/z/y", False),
    ("*a?c", "aabac", False),
    ("*a?c", "xaxaac", True),
    ("*.t*s", "a.test.ts", True),
    ("**/a/**/b", "a/x/a/b", True),
    ("**/a/**/b", "x/a/y/z/b", True),
    ("**/a/**/b", "xa/b", False),
    ("**/a*/b/**/c", "a1/a2/b/c", True),
    ("**/a/b/**", "a/a/b/c", True),
    ("**/a/b/**", "a/b", False),
    ("x/**/a/b", "x/a/a/b", True),
    ("x/**/a/b", "x/a/c/b", False),
    ("**/**/a", "a", True),
    ("a**b", "axxb", True),
    ("*[ab]*[ab]", "xaxb", True),
    ("*[ab]*[ab]", "xax", False),
]


@pytest.mark.parametrize("pattern", ["foo[", "[z-a].ts", "x\\", "a{b", "(", "*[", "\\", "[", "[]", "[!]", "**", "/"])
def test_odd_extra_excludes(make_files, pattern):
    files = make_files({"p": {"a.ts": "", "b.ts": ""}})
    out = selection.select_files(files, exclude_patterns=(pattern, "b.ts"))
    assert paths(out) == (set() if pattern == "**" else {"a.ts"})


def test_ignore_rules(make_files):
    projects = {f"{i:02}": {".gitignore": r, p: ""} for i, (r, p, _) in enumerate(GIT_CASES)}
    files = make_files(projects)
    marked = gitignore.with_ignored(files, gitignore.ignore_rules(files))
    got = {(r.project_id, r.path): r.ignored for r in marked.collect()}
    wrong = [
        (r, p, want) for i, (r, p, want) in enumerate(GIT_CASES) if got[(f"{i:02}", p)] != want
    ]
    assert wrong == []


STARS = "*a" * 30 + "*b"


def test_many_wildcards_take_no_time(make_files):
    """Thirty stars against names and directories of 4,000 characters, matching or just not."""
    import time

    long = {"a" * 4000: False, "a" * 3999 + "b": True, "a/" * 2000 + "b": False, "x" * 4000: False}
    lines = f"{STARS}\n**/a*a*a*b/**/a*a*c/**/q\n[!/]*[a]*[a]*[a]*[a]*[a]*[a]*d\n"
    files = make_files({"p": {".gitignore": lines, **{p: "" for p in long}}})
    marked = gitignore.with_ignored(files, gitignore.ignore_rules(files)).where("path <> '.gitignore'")
    marked.collect()
    start = time.perf_counter()
    assert {r.path: r.ignored for r in marked.collect()} == long
    assert time.perf_counter() - start < 5
    few = make_files({"p": {p: "" for p in long}})
    assert paths(selection.select_files(few, exclude_patterns=(STARS,))) == set()


def test_rules_of_a_large_fleet_are_met_by_paths_alone(make_files, monkeypatch):
    projects = {f"{i:03}": {".gitignore": r, p: "", "kept.ts": ""} for i, (r, p, _) in enumerate(GIT_CASES)}
    files = make_files(projects)
    want = gitignore.with_ignored(files, gitignore.ignore_rules(files)).orderBy("project_id", "path").collect()
    for name in ("BROADCAST_RULES", "BROADCAST_PROJECTS"):
        with monkeypatch.context() as m:
            m.setattr(gitignore, name, 1)
            got = gitignore.with_ignored(files, gitignore.ignore_rules(files))
            assert got.columns == [*files.columns, "ignored"]
            assert got.orderBy("project_id", "path").collect() == want
            extra = gitignore.with_ignored(files, gitignore.ignore_rules(files), True, ("kept.ts",))
            assert {r.ignored for r in extra.where("path = 'kept.ts'").collect()} == {True}


def test_ignore_case_is_an_option(make_files):
    files = make_files({"p": {".gitignore": "A.TS", "a.ts": ""}})
    assert paths(selection.select_files(files, ignore_case=False)) == {".gitignore", "a.ts"}
    assert paths(selection.select_files(files)) == {".gitignore"}


def test_extra_excludes_come_after_the_files_rules(make_files):
    files = make_files({"p": {".gitignore": "x/\na.ts", "x/b.ts": "", "a.ts": "", "c.ts": ""}})
    out = selection.select_files(files, exclude_patterns=("!a.ts", "c.*"))
    assert paths(out) == {".gitignore", "a.ts"}


def test_excluded_directories_cannot_be_taken_back(make_files):
    files = make_files({"p": {".gitignore": "!node_modules/a.ts", "node_modules/a.ts": ""}})
    assert paths(selection.select_files(files)) == {".gitignore"}


def test_many_plain_patterns_agree_with_fnmatch(make_files):
    names = [f"{a}{b}.{e}" for a in "abc" for b in "xyz" for e in ("ts", "js")]
    globs = ["a*.ts", "?y.*", "*z.js", "c[xy].ts"]
    files = make_files({g: {".gitignore": g, **{n: "" for n in names}} for g in globs})
    marked = gitignore.with_ignored(files, gitignore.ignore_rules(files))
    for r in marked.where("path <> '.gitignore'").collect():
        assert r.ignored == fnmatch.fnmatchcase(r.path, r.project_id), r


@pytest.mark.parametrize("cap", [1, 3, 50])
def test_cap_keeps_the_first_paths(make_files, cap):
    projects = {"big": {f"f{i:03}.ts": "" for i in range(40)}, "small": {"a.ts": "", "b.ts": ""}}
    out = selection.cap_files(make_files(projects), cap)
    got = {}
    for r in out.collect():
        got.setdefault(r.project_id, []).append(r.path)
    assert {p: sorted(v) for p, v in got.items()} == {
        p: sorted(v)[:cap] for p, v in projects.items()
    }


def test_cap_counts_selected_files_only(make_files):
    files = make_files({"p": {"a.md": "", "b.ts": "", "c.ts": "", "d.ts": ""}})
    assert paths(selection.select_files(files, max_files=2)) == {"b.ts", "c.ts"}


def test_targets_replace_discovery(spark, make_files):
    files = make_files({"p": {"a.md": "", "b.ts": ""}, "q": {"a.md": ""}})
    targets = spark.createDataFrame([("p", "a.md")], "project_id string, path string")
    assert selection.target_files(files, targets).collect() == files.where(
        "project_id = 'p' and path = 'a.md'"
    ).collect()
    marked = selection.mark_selected(files, targets=targets)
    assert marked.where("selected").count() == 1


def test_classes(make_files):
    files = make_files({"p": {"app/api/a.ts": "'use client' 'use server'", "pages/x.js": ""}})
    rows = {r.path: r for r in selection.classify(files).collect()}
    assert rows["app/api/a.ts"].file_side == "both" and rows["app/api/a.ts"].is_api_route
    assert rows["pages/x.js"].file_side == "client" and not rows["pages/x.js"].is_api_route
