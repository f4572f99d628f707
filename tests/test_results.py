"""Scores, order, plans, places, comparisons."""

import random

import pytest

from fleetscan import ScanConfig, scan
from fleetscan import values as V
from fleetscan.operators import diff, locate, repair, scoring
from fleetscan.operators.findings import FINDING_SCHEMA, enabled_by_project, find_first, min_severity
from tests.test_context import APP

NAMES = [c.split()[0] for c in FINDING_SCHEMA.split(", ")]


def finding(i, project="p", severity="low", category="structure", **more):
    row = dict.fromkeys(NAMES)
    row.update(
        project_id=project, id=f"{project}-{i}", rule_id="r/x", title=f"t{i}", severity=severity,
        category=category, deploy_blocking=False, confidence="high", plain_english_problem="",
        why_it_matters="", fix_steps=[], auto_fix_available=False,
        severity_rank=V.SEVERITY_RANK[severity], detector_ord=0, tail=0, rule_ord=0, ordinal=i,
    )
    row.update(more)
    return tuple(row[n] for n in NAMES)


def table(spark, rows):
    return spark.createDataFrame(rows, FINDING_SCHEMA)


def projects_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "project_id string")


def test_small_application_end_to_end(make_files):
    tables = scan(make_files({"p": APP}), ScanConfig(root="."))
    steps = {r.order: r for r in tables.steps.collect()}
    rules = {r.id: r.rule_id for r in tables.findings.collect()}
    assert [rules[steps[i].finding_id] for i in range(1, 6)] == [
        "auth/missing-route-auth", "validation/missing-body-validation",
        "structure/missing-gitignore", "structure/missing-readme", "structure/missing-tests",
    ]
    assert [steps[i].cumulative_minutes for i in range(1, 6)] == [15, 25, 35, 40, 45]
    row = tables.projects.first()
    assert (row.score, row.deploy_status, row.exit_code, row.total) == (62, "blocker", 1, 5)
    assert tables.plan.first().estimated_minutes == 45
    decided = scoring.decision(tables.findings, tables.facts).first()
    assert decided.reason == "1 critical and 2 high findings."
    assert decided.next_action == "First: API route without a sign-in check"


def test_one_critical_secret(spark):
    rows = table(spark, [finding(1, severity="critical", category="secret")])
    projects = projects_of(spark, "p", "clean")
    scores = {r.project_id: r for r in scoring.score(rows, projects).collect()}
    assert (scores["p"].score, scores["p"].deploy_status, scores["p"].exit_code) == (70, "blocker", 1)
    assert (scores["clean"].score, scores["clean"].deploy_status) == (100, "safe")
    plan = {r.project_id: r for r in repair.repair_plan(rows, projects).collect()}
    assert (plan["p"].steps, plan["p"].estimated_minutes, plan["clean"].steps) == (1, 15, 0)
    assert min_severity(table(spark, [finding(1)]), "medium").count() == 0


def test_scores_against_plain_arithmetic(spark):
    rng = random.Random(7)
    rows, want, folded = [], {}, {}
    for p in range(60):
        picks = [(rng.choice(V.SEVERITIES), rng.choice(V.CATEGORIES)) for _ in range(rng.randint(1, 14))]
        picks.sort(key=lambda sc: (V.SEVERITY_RANK[sc[0]], V.CATEGORIES.index(sc[1])))
        total, fold = 1000, 100
        for i, (s, c) in enumerate(picks):
            rows.append(finding(i, f"p{p}", s, c, detector_ord=V.CATEGORIES.index(c)))
            total += round(V.SEVERITY_WEIGHT[s] * V.CATEGORY_MULTIPLIER[c] * 10)
            fold += V.SEVERITY_WEIGHT[s] * V.CATEGORY_MULTIPLIER[c]
        want[f"p{p}"] = max(0, (total + 5) // 10)
        folded[f"p{p}"] = max(0, int((fold + 0.5) // 1))
    rng.shuffle(rows)
    df = table(spark, rows)
    projects = df.select("project_id")
    assert {r.project_id: r.score for r in scoring.score(df, projects).collect()} == want
    assert {
        r.project_id: r.score for r in scoring.score(df, projects, "float_fold").collect()
    } == folded


@pytest.fixture(scope="module")
def many(spark):
    """One project with most of the findings, spread over all partitions, and small ones."""
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        s = rng.choice(V.SEVERITIES)
        p = "big" if i < 1200 else f"s{i % 40}"
        rows.append(
            finding(
                i, p, s, detector_ord=rng.randint(0, 8), tail=rng.randint(0, 1),
                file=rng.choice([None, f"f{rng.randint(0, 50):02}.ts"]), line=rng.choice([None, rng.randint(1, 9)]),
            )
        )
    return rows


def place(row):
    r = dict(zip(NAMES, row))
    return (r["severity_rank"], r["detector_ord"], r["tail"], r["file"] or "", r["line"] or 0,
            r["rule_ord"], r["ordinal"])


def expected_order(rows):
    out = {}
    for p in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == p), key=place)
        out.update({r[1]: i for i, r in enumerate(ranked, 1)})
    return out


def test_order_over_many_partitions(spark, many):
    df = table(spark, many).repartition(7)
    steps = repair.repair_steps(df).collect()
    assert {s.finding_id: s.order for s in steps} == expected_order(many)
    minutes = 0
    for s in sorted((s for s in steps if s.project_id == "big"), key=lambda s: s.order):
        minutes += s.estimated_minutes
        assert s.cumulative_minutes == minutes
    assert repair.ordered(df).count() == len(many)


def test_first_steps(spark, many):
    want = {i: o for i, o in expected_order(many).items() if o <= 4}
    df = table(spark, many)
    assert {r.id: r.order for r in repair.top_steps(df, 4, salts=3).collect()} == want
    assert {r.id for r in find_first(df, "r/x").collect()} == {i for i, o in want.items() if o == 1}


def test_positions(spark):
    rows = [
        finding(1, file="a.ts", line=3, severity="low"),
        finding(2, file="a.ts", line=2, end_line=4, severity="medium"),
        finding(3, file="a.ts", line=None, severity="high"),
        finding(4, file="b.ts", line=9),
        finding(5, file=None),
    ]
    cursors = [("p", "a.ts", i) for i in range(5)] + [("p", "b.ts", 8), ("q", "a.ts", 2)]
    positions = spark.createDataFrame(cursors, "project_id string, path string, pos int")
    hits = locate.position_lookup(table(spark, rows), positions).collect()
    assert {(r.path, r.pos): r.id for r in hits} == {
        ("a.ts", 0): "p-3", ("a.ts", 1): "p-2", ("a.ts", 2): "p-2", ("a.ts", 3): "p-2",
        ("b.ts", 8): "p-4",
    }


def test_findings_within_documents(spark, make_files):
    rows = [finding(i, file="a.ts", line=i) for i in range(1, 5)] + [finding(9, file="gone.ts", line=1)]
    kept = locate.within_document(table(spark, rows), make_files({"p": {"a.ts": "x\ny\n"}}))
    assert {r.line for r in kept.collect()} == {1, 2, 3}
    (marks,) = locate.by_file(table(spark, rows[:4])).collect()
    assert marks.n == 4 and [m.line for m in marks.marks] == [1, 2, 3, 4]


def test_diff_treats_absent_places_as_equal(spark):
    before = table(spark, [finding(1), finding(2), finding(3, file="a", line=1), finding(4, file="b")])
    after = table(spark, [finding(1), finding(5, file="c"), finding(4, file="b")])
    rows = {(r.file, r.line): (r.n_before, r.n_after, r.status) for r in diff.scan_diff(before, after).collect()}
    assert rows == {
        (None, None): (2, 1, "persisting"), ("a", 1): (1, 0, "resolved"),
        ("b", None): (1, 1, "persisting"), ("c", None): (0, 1, "new"),
    }
    checked = diff.verify_fixes(before, after).collect()
    assert {(r.file, r.still_exists) for r in checked} == {(None, True), ("a", False), ("b", True)}


def test_shares_and_groups(spark):
    rows = table(spark, [finding(1, severity="high"), finding(2), finding(3)])
    shares = {r.project_id: r for r in scoring.severity_share(rows, projects_of(spark, "p", "q")).collect()}
    assert shares["p"].high_pct == 1 / 3 * 100 and shares["p"].critical_pct == 0
    assert shares["q"].low_pct == 0
    assert {(r.severity, r.n) for r in scoring.by_severity(rows).collect()} == {("high", 1), ("low", 2)}


def test_status_texts(spark):
    scores = scoring.score(table(spark, [finding(1)]), projects_of(spark, "p"))
    assert scoring.status_texts(scores).first().status_label == "Ready to deploy"


def test_fleet_cube(spark):
    rows = [("safe", "nextjs", 90, 1), ("safe", "vite", 80, 2), ("danger", "vite", 10, 9)]
    df = spark.createDataFrame(rows, "deploy_status string, framework string, score int, total bigint")
    cube = {(r.deploy_status, r.framework): r.projects for r in scoring.fleet_cube(df).collect()}
    assert cube[(None, None)] == 3 and cube[("safe", None)] == 2 and cube[(None, "vite")] == 2


def test_categories_per_project(spark):
    rows = table(
        spark,
        [finding(1, p, category=c) for p in "abcd" for c in ("auth", "structure")],
    )
    settings = spark.createDataFrame(
        [("a", ["auth"]), ("b", []), ("c", None)], "project_id string, categories array<string>"
    )
    kept = {(r.project_id, r.category) for r in enabled_by_project(rows, settings).collect()}
    assert kept == {("a", "auth")} | {(p, c) for p in "cd" for c in ("auth", "structure")}


def test_blocks_make_up_their_span(spark):
    from pyspark.sql import functions as F

    spans = [(a, b) for a in range(20) for b in range(a, 24)] + [(5, 1_000_000), (0, 2**31 - 2), (7, 7)]
    df = spark.createDataFrame(spans, "a int, b int")
    for r in df.select("a", "b", locate.blocks_of(F.col("a"), F.col("b")).alias("at")).collect():
        pieces = sorted((x.block << x.level, (x.block + 1) << x.level) for x in r["at"])
        assert pieces[0][0] == r.a and pieces[-1][1] == r.b + 1 and len(pieces) <= 62
        assert all(x[1] == y[0] for x, y in zip(pieces, pieces[1:]))


def test_positions_in_long_spans(spark):
    rng = random.Random(4)
    rows, spans = [], []
    for k in range(60):
        start, size = rng.randint(1, 3000), rng.choice([0, 1, 7, 500, 2_000_000])
        spans.append((start - 1, start - 1 + size, k))
        rows.append(finding(k, file="a.ts", line=start, end_line=start + size))
    positions = [("p", "a.ts", rng.randint(0, 4000)) for _ in range(300)] + [("p", "a.ts", 1_500_000), ("p", "b.ts", 1)]
    df = spark.createDataFrame(positions, "project_id string, path string, pos int")
    got = sorted((r.path, r.pos, r.id) for r in locate.position_lookup(table(spark, rows), df).collect())
    # of equal severity, the one that starts first counts
    first = {p: min(((a, k) for a, b, k in spans if a <= p <= b), default=None) for _, f, p in positions if f == "a.ts"}
    want = sorted((f, p, f"p-{first[p][1]}") for _, f, p in positions if f == "a.ts" and first[p])
    assert got == want
