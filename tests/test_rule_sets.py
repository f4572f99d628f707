"""Ignore files: each different text is parsed once, however many projects share it."""

from pyspark.sql import functions as F

from fleetscan.operators import gitignore
from fleetscan.operators.selection import mark_selected


def test_a_shared_text_is_parsed_once(spark, make_files, monkeypatch):
    parsed = []
    parse = gitignore.parse_rules

    def counting(lines, ignore_case=True):
        parsed.append(lines.count())
        return parse(lines, ignore_case)

    monkeypatch.setattr(gitignore, "parse_rules", counting)
    texts = ["docs/\n*.ts", "docs/\n*.ts", "# note\ndocs/\n*.ts", "", "src/"]
    files = make_files(
        {f"p{i}": {".gitignore": texts[i % 5], "docs/a.md": "", "src/a.ts": "", "b.js": ""} for i in range(30)}
    )
    marked = mark_selected(files).where("path <> '.gitignore'").collect()
    # three texts with lines of their own, the empty one, however many projects there are
    assert parsed == [2 + 3 + 1 + 1]
    for r in marked:
        kind = int(r.project_id[1:]) % 5
        ignored = (kind < 3 and r.path in ("docs/a.md", "src/a.ts")) or (kind == 4 and r.path == "src/a.ts")
        assert r.selected == (not ignored and not r.path.endswith(".md")), r


def test_rule_sets_are_held_once(spark, make_files):
    files = make_files(
        {f"p{i}": {".gitignore": ["a\n", "b\n", "# the same\nb\n"][min(i, 2)]} for i in range(9)} | {"q": {"a": "x"}}
    )
    sets = gitignore.file_rule_sets(files)
    rows = {r.project_id: r for r in sets.collect()}
    assert set(rows) == {f"p{i}" for i in range(9)}
    assert rows["p0"].set_id == "p0" and {rows[f"p{i}"].set_id for i in range(1, 9)} == {"p1"}
    assert sorted(p for p, r in rows.items() if r.rules) == ["p0", "p1"]
    plain = {r.project_id: r.set_id for r in gitignore._rule_sets(gitignore.ignore_rules(files)).collect()}
    assert plain == {p: r.set_id for p, r in rows.items()}


def test_two_ignore_files_of_a_project_are_read_line_by_line(spark, make_files):
    files = make_files({"p": {".gitignore": "a.ts", "a.ts": "", "b.ts": ""}})
    twice = files.unionByName(files.where("path = '.gitignore'").withColumn("content", F.lit("b.ts")))
    kept = mark_selected(twice).where("selected and path like '%.ts'")
    assert kept.count() == 0 and mark_selected(twice).count() == 4
