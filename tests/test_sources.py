import json
import os

import pytest
from pyspark.sql import functions as F

from fleetscan import ScanConfig, decode, read_corpus, read_trees, scan
from fleetscan.sources.commits import Commits
from fleetscan.sources.sinks import read_tables, result_documents, vacuum, write_documents, write_tables
from fleetscan.sources.trees import list_trees, read_listed, skipped_files


def tree(root, files):
    for path, data in files.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)


def test_trees_keep_dotfiles_and_prune(spark, tmp_path):
    tree(
        tmp_path,
        {
            "p/.env": b"A=1", "p/.gitignore": b"x\r\n", "p/src/deep/a.ts": "é\r\nb".encode(),
            "p/src/_b.ts": b"\xff\xfe ok", "p/node_modules/x/a.js": b"no", "p/src/dist/c.js": b"no",
            "p/empty.ts": b"", "q/README.md": b"# q", "loose.txt": b"not in a project",
        },
    )
    os.symlink(tmp_path / "p" / "src", tmp_path / "q" / "linked")
    os.symlink(tmp_path / "p", tmp_path / "p" / "src" / "loop")
    raw = read_trees(spark, str(tmp_path))
    rows = {(r.project_id, r.path): r.content for r in decode(raw).collect()}
    assert rows[("p", ".env")] == "A=1" and rows[("p", ".gitignore")] == "x\r\n"
    assert rows[("p", "src/deep/a.ts")] == "é\r\nb" and rows[("p", "empty.ts")] == ""
    assert rows[("p", "src/_b.ts")].endswith(" ok")
    assert ("q", "linked/deep/a.ts") in rows and ("q", "README.md") in rows
    assert not any("node_modules" in p or "dist" in p for _, p in rows)
    unlinked = read_trees(spark, str(tmp_path), follow_links=False)
    assert unlinked.where("project_id = 'q'").count() == 1
    # One listing task per directory of a project's root, so one project is many tasks.
    assert list_trees(spark, str(tmp_path)).rdd.getNumPartitions() == 4


def test_large_files_are_reported(spark, tmp_path):
    tree(tmp_path, {"p/big.ts": b"x" * 100, "p/small.ts": b"x"})
    raw = read_trees(spark, str(tmp_path), max_bytes=50)
    assert [r.message for r in skipped_files(raw).collect()] == ["big.ts: larger than 50 bytes"]
    files = decode(raw)
    assert {r.path: r.content for r in files.collect()} == {"big.ts": "", "small.ts": "x"}
    tables = scan(files, ScanConfig(root="."))
    assert tables.facts.first().files_scanned == 1 and tables.files.count() == 1
    assert [r.message for r in tables.errors.collect()] == ["big.ts: larger than 50 bytes"]


def test_one_directory_of_many_files_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from fleetscan.sources import trees

    tree(tmp_path, {f"p/src/f{i}.ts": b"x" * i for i in range(200)})
    monkeypatch.setattr(trees, "PART_FILES", 20)
    raw = read_trees(spark, str(tmp_path))
    assert raw.rdd.getNumPartitions() == 10
    assert {r.path: len(r.bytes) for r in raw.collect()} == {f"src/f{i}.ts": i for i in range(200)}
    sizes = raw.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 60
    monkeypatch.setattr(trees, "PART_BYTES", 1000)
    assert read_trees(spark, str(tmp_path)).rdd.getNumPartitions() == 20


def test_only_wanted_files_are_opened(spark, tmp_path):
    tree(tmp_path, {"p/.gitignore": b"a", "p/a.ts": b"1", "q/src/.gitignore": b"b", "q/src/b.ts": b"2"})
    os.chmod(tmp_path / "p" / "a.ts", 0)
    only = F.col("path").endswith(".gitignore")
    names = list_trees(spark, str(tmp_path)).where(only)
    raw = read_listed(names, str(tmp_path))
    assert sorted((r.project_id, r.path, bytes(r.bytes)) for r in raw.collect()) == [
        ("p", ".gitignore", b"a"), ("q", "src/.gitignore", b"b"),
    ]
    for name in ("p/.gitignore", "q/src/b.ts"):
        os.utime(tmp_path / name, (1, 1))
    old = read_trees(spark, str(tmp_path), only=F.col("changed") < "2000-01-01")
    assert sorted((r.project_id, r.path) for r in old.collect()) == [("p", ".gitignore"), ("q", "src/b.ts")]


def test_empty_root(spark, tmp_path):
    assert read_trees(spark, str(tmp_path)).count() == 0


def test_corpus_table(spark, tmp_path, make_files):
    path = str(tmp_path / "corpus")
    make_files({"p": {"a\\b.ts": "x", "c.ts": None}}).write.parquet(path)
    rows = {r.path: r.content for r in read_corpus(spark, path).collect()}
    assert rows == {"a/b.ts": "x", "c.ts": ""}


def test_result_tables_and_documents(spark, tmp_path, make_files):
    logs = "console.log(1)\n" * 25
    tables = scan(make_files({"p": {"a.ts": logs}, "q": {"README.md": ""}}), ScanConfig(root="."))
    for _ in range(2):
        write_tables(tables, str(tmp_path / "out"), "2024-01-01")
    write_tables(tables, str(tmp_path / "out"), "2024-01-02")
    written = read_tables(spark, str(tmp_path / "out"), "findings")
    n = tables.findings.count()
    assert written.count() == 2 * n and written.where("scan_date = '2024-01-01'").count() == n
    documents = result_documents(tables.projects, tables.findings, "2024-01-01T00:00:00Z", chunk=10)
    write_documents(documents, str(tmp_path / "json"))
    rows = spark.read.json(str(tmp_path / "json")).collect()
    head = next(json.loads(r.document) for r in rows if r.project_id == "p" and r.part == 0)
    assert head["projectContext"]["language"] == "javascript" and head["summary"]["lowCount"] == 27
    parts = [json.loads(r.document) for r in sorted(rows, key=lambda r: r.part) if r.project_id == "p" and r.part]
    assert [len(p) for p in parts] == [10, 10, 8]
    assert [f["order"] for p in parts for f in p] == list(range(1, 29))


def test_a_failed_write_leaves_what_was_published(spark, tmp_path, make_files):
    out = str(tmp_path / "out")
    tables = scan(make_files({"p": {"a.ts": "console.log(1)"}}), ScanConfig(root="."))
    with pytest.raises(ValueError):
        read_tables(spark, out, "findings")
    write_tables(tables, out, "2024-01-01")
    before = sorted(read_tables(spark, out, "findings").collect())
    tables.projects = tables.projects.withColumn("score", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        write_tables(tables, out, "2024-01-01")
    assert sorted(read_tables(spark, out, "findings").collect()) == before
    assert vacuum(spark, out) == 0


def test_replaced_dates_are_removed_when_asked(spark, tmp_path, make_files):
    out = str(tmp_path / "out")
    for text in ("console.log(1)", "clean"):
        write_tables(scan(make_files({"p": {"a.ts": text}}), ScanConfig(root=".")), out, "2024-01-01")
    assert len(os.listdir(tmp_path / "out" / "data")) == 2 and vacuum(spark, out) == 1
    assert len(os.listdir(tmp_path / "out" / "data")) == 1
    log = "rule_id = 'code_quality/console-log'"
    assert read_tables(spark, out, "findings", ["2024-01-01"]).where(log).count() == 0


def test_of_two_writers_one_is_told(spark, tmp_path):
    one, two = (Commits(spark, str(tmp_path / "c")) for _ in range(2))
    number, _ = one.read()
    assert one.write(number, {"a": "é"}) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        two.write(number, {"a": 2})
    assert two.read() == (1, {"a": "é"})
    for k in range(1, 9):
        one.write(k, {"a": k})
    assert two.read() == (9, {"a": 8}) and len([n for n in os.listdir(tmp_path / "c") if n.endswith(".json")]) == 3
