import datetime as dt
import os
import random

import pytest

from fleetscan import IncrementalScan, ScanConfig, debounce, scan
from fleetscan.plans.sizing import fresh_path
from fleetscan.streaming import layers
from fleetscan.streaming.saves import SessionLog, code_saves, watched

SCHEMA = "project_id string, path string, content string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def save(path, content, seconds, project="p"):
    return (project, path, content, START + dt.timedelta(seconds=seconds))


SAVES = [
    save("a.ts", "console.log(1)", 0),
    save("b.ts", "x", 0.5),
    save("a.ts", "console.log(1)\nconsole.log(2)", 1),
    save("notes.md", "console.log(3)", 1),
    save("a.ts", "clean", 9),
    save("c.ts", "try {} catch (e) {}", 9.2, "q"),
]
CLOSING = save("z.ts", "", 100)


def stream(spark, tmp_path, rows):
    path = str(tmp_path / "saves")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def test_debounce(spark):
    rows = debounce(code_saves(spark.createDataFrame(SAVES, SCHEMA))).collect()
    assert {(r.path, r.content, r.saves) for r in rows} == {
        ("a.ts", "console.log(1)\nconsole.log(2)", 2), ("a.ts", "clean", 1), ("b.ts", "x", 1),
        ("c.ts", "try {} catch (e) {}", 1),
    }


@pytest.fixture
def seeded(spark, make_files):
    files = {
        "p": {"a.ts": "fetch('http://localhost')", "d.ts": "console.log(0)", "README.md": ""},
        "r": {"a.ts": "console.log(0)"},
    }
    state = IncrementalScan(spark, fresh_path(spark, "state"), buckets=4)
    state.seed(scan(make_files(files), ScanConfig(root=".")).observations, make_files(files))
    return state, files


def results(state):
    found = {(r.project_id, r.rule_id, r.file, r.line) for r in state.findings().collect()}
    scores = {(r.project_id, r.score, r.deploy_status, r.total) for r in state.projects().collect()}
    return found, scores


def full_scan(make_files, files):
    tables = scan(make_files(files), ScanConfig(root="."))
    found = {(r.project_id, r.rule_id, r.file, r.line) for r in tables.findings.collect()}
    scores = {(r.project_id, r.score, r.deploy_status, r.total) for r in tables.projects.collect()}
    return found, scores


def later(files, **saved):
    out = {p: dict(fs) for p, fs in files.items()}
    for place, content in saved.items():
        project, name = place.split("_")
        out.setdefault(project, {})[f"{name}.ts"] = content
    return out


def test_stream_equals_a_full_rescan(spark, tmp_path, make_files, seeded):
    state, files = seeded
    rows = stream(spark, tmp_path, SAVES + [CLOSING])
    checkpoint = str(tmp_path / "checkpoint")
    query = state.start(rows, checkpoint, availableNow=True)
    assert query.awaitTermination(120)
    now = later(files, p_a="clean", p_b="x", q_c="try {} catch (e) {}", p_z="")
    assert results(state) == full_scan(make_files, now)
    # More saves, same checkpoint. One of a.ts is older than what is known, one of d.ts is the
    # first of that file although other files were saved long after it.
    late = [save("a.ts", "console.log(9)", 3), save("d.ts", "ok", 4), save("end.ts", "", 300)]
    query = state.start(stream(spark, tmp_path, late), checkpoint, availableNow=True)
    assert query.awaitTermination(120)
    assert results(state) == full_scan(make_files, later(now, p_d="ok", p_end=""))
    assert results(state.compact(fresh_path(spark, "state"))) == results(state)


def test_a_batch_may_be_applied_again(spark, make_files, seeded):
    state, files = seeded
    batch = make_files({"p": {"a.ts": "any " * 30, "e.ts": "console.log(1)"}})
    state.apply(batch, 0)
    once = results(state)
    state.apply(batch, 0)
    assert results(state) == once
    want = full_scan(make_files, later(files, p_a="any " * 30, p_e="console.log(1)"))
    assert once == want
    assert results(state.compact(fresh_path(spark, "state"))) == want


def test_an_empty_batch_changes_nothing(spark, make_files, seeded):
    state, files = seeded
    state.apply(make_files({"p": {"a.ts": ""}}).limit(0), 0)
    assert results(state) == full_scan(make_files, files)


def test_root_files_and_ignored_places(spark, make_files, seeded):
    """Saves of context files count, and saves in excluded or ignored places are not looked at."""
    state, files = seeded
    state.apply(make_files({"p": {".gitignore": "gen/\n", "package.json": '{"dependencies": {"next": "^1"}}'}}), 0)
    log = "console.log(7)"
    state.apply(make_files({"p": {"gen/a.ts": log, "node_modules/b.ts": log, "ok.ts": log, ".env": "A=1"}}), 1)
    state.apply(make_files({"r": {"gen/a.ts": log, ".gitignore": "", "README.md": "#"}}), 2)
    state.apply(make_files({"p": {"package.json": "{broken", "new/package.json": '{"scripts": {"install": "x"}}'}}), 3)
    now = {p: dict(f) for p, f in files.items()}
    now["p"] |= {
        ".gitignore": "gen/\n", "package.json": "{broken", "gen/a.ts": log, "node_modules/b.ts": log, "ok.ts": log,
        ".env": "A=1", "new/package.json": '{"scripts": {"install": "x"}}',
    }
    now["r"] |= {"gen/a.ts": log, ".gitignore": "", "README.md": "#"}
    assert results(state) == full_scan(make_files, now)


def test_watched_files(spark):
    names = ["a.ts", "b.md", "package.json", "x/package.json", ".gitignore", "x/.gitignore", ".env", "README.md", "x/README.md"]
    df = spark.createDataFrame([("p", n, "", START) for n in names], SCHEMA)
    assert {r.path for r in watched(df).collect()} == {
        "a.ts", "package.json", "x/package.json", ".gitignore", ".env", "README.md",
    }


def test_many_batches_in_any_order_stay_in_few_layers(spark, make_files, seeded, monkeypatch):
    monkeypatch.setattr(layers, "FAN", 3)
    state, files = seeded
    rng = random.Random(6)
    saves = [("p", f"{rng.choice('abcd')}.ts", rng.choice(["clean", "console.log(1)", "any " * 9]), t) for t in range(60)]
    saves += [("r", "package.json", f'{{"scripts": {{"test{t}": "x"}}}}', t) for t in (3, 50)]
    order = rng.sample(saves, len(saves))
    most = 0
    for batch in range(12):
        rows = [(p, n, c, START + dt.timedelta(seconds=t)) for p, n, c, t in order[batch::12]]
        state.apply(spark.createDataFrame(rows, SCHEMA.replace("ts ", "saved_at ")), batch)
        most = max(most, *(len(state.layers.folders(t)) for t in ("observations", "parts", "projects")))
    # two of each tier at most, and the seed
    assert most <= 1 + 2 * 3
    now = {p: dict(f) for p, f in files.items()}
    for p, n, c, _ in sorted(saves, key=lambda s: s[3]):
        now[p][n] = c
    assert results(state) == full_scan(make_files, now)
    base = state.layers.path.removeprefix("file:")
    kept = {n for t in ("observations", "parts") for n in os.listdir(f"{base}/{t}")}
    assert len(kept) <= 2 * (1 + 2 * 3 + 3 * 3)  # replaced layers go with the next commit


def test_a_batch_that_failed_half_way_is_done_again(spark, make_files, seeded, monkeypatch):
    state, files = seeded
    batch = make_files({"p": {"a.ts": "console.log(1)"}})
    before = results(state)
    with monkeypatch.context() as m:
        m.setattr(state.layers, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.apply(batch, 0)
    assert results(state) == before
    state.apply(batch, 0)
    assert results(state) == full_scan(make_files, later(files, p_a="console.log(1)"))


def test_sessions_in_batches_of_any_order(spark, monkeypatch):
    monkeypatch.setattr(layers, "FAN", 2)
    rng = random.Random(8)
    rows = [save(f"{rng.choice('ab')}.ts", f"text {k}", k + rng.choice([0, 0, 5]), rng.choice("pq")) for k in range(80)]
    whole = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in debounce(whole, "3 seconds").select("project_id", "path", "saved_at", "saves").collect())
    log = SessionLog(spark, fresh_path(spark, "sessions"), "3 seconds", buckets=2)
    rng.shuffle(rows)
    for batch in range(5):
        log.apply(spark.createDataFrame(rows[batch::5], SCHEMA), batch)
        log.apply(whole, batch)  # counts already
    got = sorted(tuple(r) for r in log.sessions().select("project_id", "path", "saved_at", "saves").collect())
    assert got == want and len(log.layers.folders("sessions")) <= 3


def test_a_session_log_runs_on_a_stream(spark, tmp_path):
    log = SessionLog(spark, fresh_path(spark, "sessions"), buckets=2)
    checkpoint = str(tmp_path / "checkpoint")
    for rows in (SAVES, [save("a.ts", "last", 9.5)]):
        query = log.start(stream(spark, tmp_path, rows), checkpoint, availableNow=True)
        assert query.awaitTermination(120)
    want = debounce(code_saves(spark.createDataFrame([*SAVES, save("a.ts", "last", 9.5)], SCHEMA)))
    assert sorted(log.sessions().collect()) == sorted(want.collect())
