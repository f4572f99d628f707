"""One registered query per operator, all over whole tables.

Each takes ``(spark, sf_dir)``. The corpus is derived in :mod:`workload.corpus`; columns are
scalars so that results compare with SQL row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscan.config import ScanConfig
from fleetscan.functions import text as T
from fleetscan.functions.severity import worst_severity
from fleetscan.operators import context as ctx
from fleetscan.operators import diff, fixes, gitignore, locate, repair, scoring, selection
from fleetscan.operators import findings as fnd
from fleetscan.operators.observe import observe
from fleetscan.operators.suppress import inline_ignores
from fleetscan.plans.scan import Rescan, ScanTables, detector_errors, rescan, scan
from fleetscan.plans.sizing import fresh_path, small_side, stored
from fleetscan.rules.builtin import default_registry
from fleetscan.rules.model import DetectorSpec, Registry
from fleetscan.sources.corpus import read_corpus
from fleetscan.sources.sinks import read_tables, result_documents, vacuum, write_tables
from fleetscan.sources.trees import decode, read_trees
from fleetscan.streaming.saves import IncrementalScan, SessionLog, code_saves, debounce
from workload import corpus

FINDING = [
    "project_id", "rule_id", "severity", "category", "deploy_blocking", "confidence", "file",
    "line", "evidence",
]
EXCLUDES = ("c*o*m*p*o*n*e*n*t*s*/", "/src/s*1.ts", "pages/**", "!pages/p1*.tsx")
CAP = 12
STREAM_GAP = "6 hours"


# --- inputs ------------------------------------------------------------------------------


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.all_files(spark, sf_dir)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.mark_selected(listing(spark, sf_dir))


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).where("selected").drop("selected")


def scan_findings(
    spark: SparkSession,
    sf_dir: str,
    registry: Registry | None = None,
    honour_ignores: bool = True,
    keep: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Findings and project facts. ``keep`` stores the observations, so that contents are
    read once although findings and facts both come from them."""
    registry = registry or default_registry()
    if honour_ignores:
        config = ScanConfig(root=sf_dir)
        tables = scan(listing(spark, sf_dir), config, registry, store=keep)
        return tables.findings, tables.facts
    rows = observe(marked(spark, sf_dir), registry, honour_ignores=honour_ignores)
    if keep:
        rows = stored(rows)
    facts = ctx.project_facts(rows, registry)
    hits = fnd.file_hits(rows).unionByName(fnd.project_hits(facts, registry))
    return fnd.describe(hits, registry), facts


def file_findings(spark: SparkSession, sf_dir: str, *rule_ids: str) -> DataFrame:
    """Findings of line and file rules only: one narrow stage, no shuffle."""
    registry = default_registry().active(rule_ids=rule_ids)
    rows = observe(marked(spark, sf_dir), registry)
    return fnd.describe(fnd.file_hits(rows), registry)


def project_findings(spark: SparkSession, sf_dir: str, *rule_ids: str) -> DataFrame:
    """Findings of project rules only."""
    registry = default_registry().active(rule_ids=rule_ids)
    facts = ctx.project_facts(observe(marked(spark, sf_dir), registry), registry)
    return fnd.describe(fnd.project_hits(facts, registry), registry)


def saves(events: DataFrame) -> DataFrame:
    """Save events derived from ``events``: a project of the corpus, a file per event type."""
    user, event = F.col("user_id"), F.col("event_id")
    number = user % 20
    project = F.when(number < 6, "mono").otherwise(
        F.concat_ws("-", F.concat(F.lit("src"), number), F.floor(user / 20))
    )
    body = (
        F.when(event % 3 == 0, F.concat(F.lit("console.log("), event, F.lit(")\n")))
        .when(event % 3 == 1, F.concat(F.lit("export const version = "), event))
        .otherwise(
            F.concat(
                F.lit('try { load() } catch (e) {}\nfetch("http://localhost:'), event, F.lit('")')
            )
        )
    )
    name = F.when(F.col("event_type") == "view", "live/notes.md").otherwise(
        F.concat(F.lit("live/"), "event_type", F.lit(".ts"))
    )
    return events.select(
        project.alias("project_id"),
        name.alias("path"),
        body.alias("content"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def event_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saves(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return saves(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


# --- selection -------------------------------------------------------------------------------


def selected_files(spark, sf_dir):
    return selected(spark, sf_dir).select("project_id", "path")


def gitignore_filter(spark, sf_dir):
    files = listing(spark, sf_dir)
    kept = gitignore.gitignore_filter(files, gitignore.ignore_rules(files))
    return kept.select("project_id", "path")


def extra_excludes(spark, sf_dir):
    files = selection.select_files(listing(spark, sf_dir), exclude_patterns=EXCLUDES)
    return files.select("project_id", "path")


def capped_files(spark, sf_dir):
    return selection.cap_files(selected(spark, sf_dir), CAP).select("project_id", "path")


def target_files(spark, sf_dir):
    """The files of all labelled documents."""
    docs = corpus.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    files = corpus.document_files(docs)
    targets = files.join(labels, "doc_id", "left_semi").select("project_id", "path")
    return selection.target_files(files, targets).select("project_id", "path")


def file_classes(spark, sf_dir):
    return selection.classify(listing(spark, sf_dir))


# --- context -----------------------------------------------------------------------------------


def project_context(spark, sf_dir):
    def shown(col):
        pairs = F.transform(F.map_entries(col), lambda e: F.concat_ws("=", e.key, e.value))
        return F.array_join(F.array_sort(pairs), ",").alias(col)

    rows = ctx.project_context(listing(spark, sf_dir))
    maps = ["dependencies", "dev_dependencies", "scripts"]
    return rows.select(*[shown(c) if c in maps else c for c in rows.columns])


# --- detectors -----------------------------------------------------------------------------------


def _file_rule(*rule_ids):
    return lambda spark, sf_dir: file_findings(spark, sf_dir, *rule_ids).select(*FINDING)


def _project_rule(*rule_ids):
    return lambda spark, sf_dir: project_findings(spark, sf_dir, *rule_ids).select(*FINDING)


def errors_of_detectors(spark, sf_dir):
    rows = observe(marked(spark, sf_dir), Registry())
    return detector_errors(ctx.project_facts(rows, Registry()))


# --- findings -------------------------------------------------------------------------------------


def all_findings(spark, sf_dir):
    rows, _ = scan_findings(spark, sf_dir)
    return rows.select("id", *FINDING, "auto_fix_available", "severity_rank", "detector_ord", "tail")


def stored_ignores(spark, sf_dir):
    rows = stored(scan_findings(spark, sf_dir, honour_ignores=False)[0])
    return inline_ignores(rows, selected(spark, sf_dir)).select(*FINDING)


def at_least_medium(spark, sf_dir):
    return fnd.min_severity(scan_findings(spark, sf_dir)[0], "medium").select(*FINDING)


def pruned_scan(spark, sf_dir):
    """The same filters at plan time, with two categories."""
    registry = default_registry().active(["code_quality", "structure"], "medium")
    return scan_findings(spark, sf_dir, registry)[0].select(*FINDING)


def some_categories(spark, sf_dir):
    rows = scan_findings(spark, sf_dir)[0]
    return fnd.enabled_categories(rows, ["auth", "dependency"]).select(*FINDING)


def categories_by_project(spark, sf_dir):
    """Every project leaves on the categories of its language only."""
    rows, facts = scan_findings(spark, sf_dir)
    some = F.when(
        F.col("language") == "typescript", F.array(F.lit("auth"), F.lit("structure"))
    )
    settings = facts.select("project_id", some.alias("categories"))
    return fnd.enabled_by_project(rows, settings).select(*FINDING)


def find_first(spark, sf_dir):
    rows = scan_findings(spark, sf_dir)[0]
    return fnd.find_first(rows, "code_quality/console-log").select("id", *FINDING)


# --- scores ---------------------------------------------------------------------------------------


def project_scores(spark, sf_dir):
    """The fused path: one pass over the contents, one shuffle of one row per project and task."""
    registry = default_registry()
    facts = ctx.project_facts(observe(marked(spark, sf_dir), registry), registry)
    return ctx.project_summary(facts, registry).select(
        "project_id", "score", "deploy_status", "exit_code", "total"
    )


def _findings_and_projects(spark, sf_dir):
    return scan_findings(spark, sf_dir, keep=True)


def score_from_findings(spark, sf_dir):
    return scoring.status_texts(scoring.score(*_findings_and_projects(spark, sf_dir)))


def score_float_fold(spark, sf_dir):
    rows, projects = _findings_and_projects(spark, sf_dir)
    return scoring.score(rows, projects, "float_fold").select("project_id", "score")


def summary(spark, sf_dir):
    rows, _ = _findings_and_projects(spark, sf_dir)
    out = scoring.summary(rows, selected(spark, sf_dir))
    counts = [
        F.col("category_counts")[c].alias(f"n_{c}")
        for c in ("secret", "auth", "authorization", "frontend_exposure", "validation",
                  "dependency", "code_quality", "structure")
    ]
    return out.select(*[c for c in out.columns if c != "category_counts"], *counts)


def severity_share(spark, sf_dir):
    return scoring.severity_share(*_findings_and_projects(spark, sf_dir))


def decision(spark, sf_dir):
    return scoring.decision(*_findings_and_projects(spark, sf_dir))


def by_severity(spark, sf_dir):
    return scoring.by_severity(scan_findings(spark, sf_dir)[0])


def worst_by_file(spark, sf_dir):
    rows = scan_findings(spark, sf_dir)[0].where("file is not null")
    return rows.groupBy("project_id", "file").agg(
        worst_severity(F.col("severity")).alias("worst"), F.count("*").alias("n")
    )


def fleet_cube(spark, sf_dir):
    registry = default_registry()
    facts = ctx.project_facts(observe(marked(spark, sf_dir), registry), registry)
    return scoring.fleet_cube(ctx.project_summary(facts, registry))


# --- repair ------------------------------------------------------------------------------------------


def repair_steps(spark, sf_dir):
    rows = repair.repair_steps(scan_findings(spark, sf_dir, keep=True)[0])
    return rows.select(
        "project_id", "order", "finding_id", "title", "severity", "category", "file", "line",
        "auto_fix_available", "estimated_minutes", "cumulative_minutes",
    )


def repair_plan(spark, sf_dir):
    return repair.repair_plan(*_findings_and_projects(spark, sf_dir))


def top_steps(spark, sf_dir):
    rows = repair.top_steps(scan_findings(spark, sf_dir)[0], 3)
    return rows.select("project_id", "order", "id", "rule_id", "severity", "file", "line")


def step_findings(spark, sf_dir):
    rows = stored(scan_findings(spark, sf_dir)[0])
    out = repair.step_findings(repair.repair_steps(rows), rows)
    return out.select("project_id", "order", "finding_id", "rule_id", "shown_evidence")


# --- places ---------------------------------------------------------------------------------------------


def by_file(spark, sf_dir):
    rows = locate.by_file(scan_findings(spark, sf_dir)[0])
    shown = F.transform(
        "marks", lambda m: F.concat_ws(":", m.line.cast("string"), m.rule_id, m.level)
    )
    return rows.select("project_id", "file", "n", F.array_join(shown, ",").alias("marks"))


def position_lookup(spark, sf_dir):
    """One cursor per document file."""
    files = corpus.document_files(corpus.documents(spark, sf_dir))
    pos = (F.floor(F.col("doc_id") / 320) % 6).cast("int")
    positions = files.select("project_id", "path", pos.alias("pos"))
    return locate.position_lookup(scan_findings(spark, sf_dir)[0], positions)


def within_document(spark, sf_dir):
    """Findings of the scan against documents that have lost their leading snippet since."""
    docs = corpus.documents(spark, sf_dir)
    now = corpus.document_files(docs).select("project_id", "path", F.col("text").alias("content"))
    rows = locate.within_document(scan_findings(spark, sf_dir)[0], now)
    return rows.select("project_id", "rule_id", "file", "line")


# --- fixes ------------------------------------------------------------------------------------------------


def _digest(rows: DataFrame, content: str) -> DataFrame:
    return rows.select("project_id", "path", F.sha2(content, 256).alias("digest"))


def _fix_inputs(spark, sf_dir):
    rows = stored(scan_findings(spark, sf_dir)[0])
    return rows, listing(spark, sf_dir)


def fixable(spark, sf_dir):
    rows = fixes.with_fixers(scan_findings(spark, sf_dir)[0])
    return rows.select(
        "project_id", "id", "rule_id", F.col("fixer").isNotNull().alias("has_fixer"),
        (F.col("auto_fix_available") & F.col("fixer").isNotNull()).alias("can_fix"),
    )


def fix_console_log(spark, sf_dir):
    rows = stored(file_findings(spark, sf_dir, "code_quality/console-log"))
    fixed = fixes.fixed_files(rows, listing(spark, sf_dir))
    return _digest(fixed, "new_content")


def fix_env_example(spark, sf_dir):
    rows = project_findings(spark, sf_dir, "structure/missing-env-example")
    return fixes.fixed_files(rows, listing(spark, sf_dir)).select(
        "project_id", "path", "new_content"
    )


def example_texts(spark, sf_dir):
    """The value-stripping rule on every environment file, nested ones included."""
    files = listing(spark, sf_dir).where("path = '.env' or endswith(path, '/.env')")
    plain = fixes.example_text(F.col("content"))
    strict = fixes.example_text(F.col("content"), keep_cr_values=True)
    return files.select(
        "project_id", "path", F.sha2(plain, 256).alias("digest"),
        F.sha2(strict, 256).alias("keep_cr_digest"),
    )


def fix_gitignore(spark, sf_dir):
    rows = project_findings(spark, sf_dir, "secret/env-not-ignored")
    return fixes.fixed_files(rows, listing(spark, sf_dir)).select(
        "project_id", "path", "new_content"
    )


def _lists_as_text(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.array_join(n, ",") for n in names})


def fix_preview(spark, sf_dir):
    rows = fixes.preview_fix(*_fix_inputs(spark, sf_dir))
    return _lists_as_text(rows, "files_to_modify", "files_to_create").drop("description")


def fix_results(spark, sf_dir):
    rows = fixes.fix_results(*_fix_inputs(spark, sf_dir))
    return _lists_as_text(rows, "files_modified", "files_created").drop("message", "error")


def apply_fix(spark, sf_dir):
    return _digest(fixes.apply_fix(*_fix_inputs(spark, sf_dir)), "content")


def fix_verify(spark, sf_dir):
    """Only what the fixes wrote is looked at again."""
    tables = scan(listing(spark, sf_dir), ScanConfig(root=sf_dir))
    rows, files = stored(tables.findings), listing(spark, sf_dir)
    fixed = small_side(fixes.fixed_files(rows, files), weigh=F.length("new_content"))
    after = rescan(tables, fixes.with_fixes(files, fixed), fixed)
    return diff.verify_fixes(fixes.fixable(rows), after.tables.findings)


# --- comparing and merging -----------------------------------------------------------------------------------


def changed_files(spark, sf_dir) -> DataFrame:
    """The corpus some time later: the labelled documents' files hold their text only."""
    docs = corpus.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    bare = labels.withColumn("bare", F.lit(True))
    files = corpus.document_files(docs).join(bare, "doc_id", "left")
    content = F.when(F.col("bare"), F.col("text")).otherwise(F.col("content"))
    later = files.select("project_id", "path", content.alias("content"))
    return later.unionByName(corpus.root_files(docs))


def labelled_files(spark, sf_dir) -> DataFrame:
    """``project_id, path`` of the files that :func:`changed_files` changes."""
    docs = corpus.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    files = corpus.document_files(docs).join(labels, "doc_id", "left_semi")
    return files.select("project_id", "path")


def _scan_and_rescan(spark, sf_dir) -> tuple[ScanTables, Rescan]:
    before = scan(listing(spark, sf_dir), ScanConfig(root=sf_dir))
    return before, rescan(before, changed_files(spark, sf_dir), labelled_files(spark, sf_dir))


def scan_diff(spark, sf_dir):
    before, after = _scan_and_rescan(spark, sf_dir)
    return diff.scan_diff(before.findings, after.tables.findings)


def merge_findings(spark, sf_dir):
    """Replacing the findings of the changed files must give the same as a full rescan."""
    before, after = _scan_and_rescan(spark, sf_dir)
    return diff.merge_findings(before.findings, after.partial, after.scope).select(*FINDING)


def rescan_scores(spark, sf_dir):
    """Scores and counts after the changes, from the sums that the changed files had and have."""
    _, after = _scan_and_rescan(spark, sf_dir)
    return after.tables.projects.select(
        "project_id", "score", "deploy_status", "total", "files_scanned", "lines_scanned"
    )


# --- options and detectors of one's own ---------------------------------------------------------------------


def project_settings(spark, sf_dir) -> DataFrame:
    """Options by project number: some categories, a severity, patterns, and two kinds of mistakes."""
    docs = corpus.documents(spark, sf_dir)
    project, number = corpus.project_of(F.col("source"), F.col("doc_id"))
    s = F.col("s")
    names = "array<string>"
    return docs.select(project.alias("project_id"), number.alias("s")).distinct().where(s % 6 != 5).select(
        "project_id",
        F.when(s % 6 == 0, F.array(F.lit("auth"), F.lit("code_quality")))
        .when(s % 12 == 4, F.array(F.lit("style"))).cast(names).alias("enabled_categories"),
        F.when(s % 6 == 1, "high").when(s % 6 == 2, "medium").alias("min_severity"),
        F.when(s % 6 == 2, F.array(F.lit("components/"))).cast(names).alias("exclude_patterns"),
        F.when(s % 12 == 3, -1).when(s % 12 == 9, 1_000_000).alias("max_files"),
    )


def scan_configs(spark, sf_dir):
    """A scan in which projects have options of their own, and its error rows."""
    tables = scan(
        listing(spark, sf_dir), ScanConfig(root=sf_dir), settings=project_settings(spark, sf_dir)
    )
    errors = tables.errors.where("detector_id = 'config'")
    rows = tables.findings.select("project_id", "rule_id", "severity", "file", "line")
    return rows.withColumn("message", F.lit(None).cast("string")).unionByName(
        errors.select("project_id", "message"), allowMissingColumns=True
    )


def _as_findings(rows: DataFrame, **given) -> DataFrame:
    """Rows of the findings schema with these columns; the others are null or, in the order, 0."""
    columns = []
    for part in fnd.FINDING_SCHEMA.split(", "):
        name, kind = part.split(" ", 1)
        value = given.get(name, F.lit(0 if name in ("tail", "rule_ord", "ordinal") else None))
        columns.append((F.col(name) if name == "project_id" else value).cast(kind).alias(name))
    return rows.select(*columns)


def _long_lines(files: DataFrame, context: DataFrame) -> DataFrame:
    """A detector of one's own: files with a line of more than 2,000 characters."""
    longest = F.array_max(F.transform(F.split("content", "\n", -1), F.length))
    rows = files.withColumn("n", longest).where("n > 2000")
    return _as_findings(
        rows, id=F.concat(F.lit("LONG-"), "path"), rule_id=F.lit("own/long-line"), title=F.lit("Long line"),
        severity=F.lit("medium"), category=F.lit("code_quality"), file=F.col("path"),
        evidence=F.col("n").cast("string"), severity_rank=F.lit(2), detector_ord=F.lit(100),
    )


def _throwing(files: DataFrame, context: DataFrame) -> DataFrame:
    """A detector that fails on the first row it meets in a task."""
    bad = F.raise_error(F.concat(F.lit("cannot read "), F.col("path")))
    return _as_findings(files, id=bad.cast("string"), severity_rank=F.lit(0), detector_ord=F.lit(101))


def custom_detectors(spark, sf_dir):
    """Two detectors beside the built-in ones, one of which throws: its error, all others' findings."""
    registry = default_registry()
    registry.register(DetectorSpec("throwing", "Throwing", "structure", _throwing, order=1))
    registry.register(DetectorSpec("long-lines", "Long lines", "code_quality", _long_lines, order=2))
    tables = scan(listing(spark, sf_dir), ScanConfig(root=sf_dir), registry)
    errors = tables.errors.where("detector_id = 'throwing'").groupBy("project_id", "detector_id").agg(
        F.count("*").alias("n")
    )
    counts = tables.findings.groupBy("project_id", "rule_id").agg(F.count("*").alias("n"))
    return counts.unionByName(
        errors.select("project_id", F.col("detector_id").alias("rule_id"), "n")
    )


def span_lookup(spark, sf_dir):
    """Three cursors per document file on findings whose spans have up to a million lines."""
    doc = F.col("doc_id")
    files = corpus.document_files(corpus.documents(spark, sf_dir)).select("project_id", "path", "doc_id")
    spans = None
    for k, (start, length) in enumerate([(doc % 7 + 1, doc * 1013 % 1_000_000), (doc % 5 + 300, doc * 31 % 5000)]):
        one = _as_findings(
            files, id=F.concat(F.lit(f"S{k}-"), "path"), rule_id=F.lit(f"own/span-{k}"), title=F.lit("Span"),
            severity=F.lit("low"), file=F.col("path"), line=start, end_line=start + length,
            severity_rank=(doc + k) % 2, detector_ord=F.lit(100),
        )
        spans = one if spans is None else spans.unionByName(one)
    places = F.array(doc % 11, doc * 7919 % 6000, doc * 104_729 % 1_000_003)
    positions = files.select("project_id", "path", F.explode(places).alias("pos")).distinct()
    return locate.position_lookup(spans, positions).select("project_id", "path", "pos", "id", "rule_id")


def tree_files(spark, sf_dir) -> DataFrame:
    """Where each file of the listing goes in a directory tree: its content, or bytes that are no
    UTF-8 in front of it for every seventh."""
    files = listing(spark, sf_dir).dropDuplicates(["project_id", "path"])
    odd = F.crc32(F.col("path").cast("binary")) % 7 == 0
    text = F.coalesce("content", F.lit("")).cast("binary")
    return files.select(
        "project_id", "path", F.when(odd, F.concat(F.unhex(F.lit("FFFE")), text)).otherwise(text).alias("bytes")
    )


def _written(batches, root):
    """Write files below ``root``, in tasks; the number written."""
    import os

    import pyarrow as pa

    for batch in batches:
        for project, path, data in zip(*(batch.column(n).to_pylist() for n in ("project_id", "path", "bytes"))):
            full = os.path.join(root, project, path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "wb") as f:
                f.write(data)
        yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})


def tree_round_trip(spark, sf_dir):
    """All files written to directories, listed, read and decoded, and as a table read again. The
    folder must be one that every executor sees as a directory."""
    files = tree_files(spark, sf_dir)
    root = fresh_path(spark, "trees").removeprefix("file://")
    files.mapInArrow(lambda b: _written(b, root), "n bigint").agg(F.sum("n")).collect()
    table = fresh_path(spark, "corpus")
    decode(read_trees(spark, root)).write.parquet(table)
    content = F.col("content")
    return read_corpus(spark, table).select(
        "project_id", "path", F.length(content).cast("int").alias("chars"), F.sha2(F.encode(content, "UTF-8"), 256).alias("digest")
    )


# --- round trips -------------------------------------------------------------------------------------------------


def tables_round_trip(spark, sf_dir):
    """Findings, steps, scores and errors published for two dates, one of them twice, read back."""
    tables = scan(listing(spark, sf_dir), ScanConfig(root=sf_dir))
    path = fresh_path(spark, "published")
    for date in ("2024-01-01", "2024-01-02", "2024-01-01"):
        write_tables(tables, path, date)
    vacuum(spark, path)
    counts = {"findings": "id", "steps": "finding_id", "projects": "score", "errors": "message"}
    out = None
    for name, column in counts.items():
        rows = read_tables(spark, path, name).groupBy("project_id", "scan_date").agg(
            F.count("*").alias("n"), F.countDistinct(column).alias("different")
        )
        rows = rows.withColumn("name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("scan_date", F.col("scan_date").cast("string"))


# --- saves ------------------------------------------------------------------------------------------------------


def debounce_saves(spark, sf_dir):
    rows = debounce(code_saves(event_saves(spark, sf_dir)), STREAM_GAP)
    return rows.select("project_id", "path", "content", "saves")


def debounce_default(spark, sf_dir):
    rows = debounce(code_saves(event_saves(spark, sf_dir)))
    return rows.select("project_id", "path", "content", "saves")


def stream_debounce(spark, sf_dir):
    """The same as a stream, read to its end: all sessions, those that are still open too."""
    log = SessionLog(spark, fresh_path(spark, "sessions"), STREAM_GAP, buckets=16)
    log.start(event_stream(spark, sf_dir), fresh_path(spark, "stream"), availableNow=True).awaitTermination()
    return log.sessions().select("project_id", "path", "content", "saves")


def stream_scores(spark, sf_dir):
    """Scores after a full scan and a stream of saves on top, of scripts, root files and files in
    ignored places."""
    state = IncrementalScan(spark, fresh_path(spark, "state"), buckets=16)
    files = listing(spark, sf_dir)
    state.seed(observe(selection.mark_selected(files), state.registry), files)
    query = state.start(
        with_other_places(event_stream(spark, sf_dir)), fresh_path(spark, "stream"), availableNow=True
    )
    query.awaitTermination()
    return state.projects().select(
        "project_id", "score", "deploy_status", "total", "files_scanned", "n_code_quality",
        "framework", "has_readme", "has_tests",
    )


def with_other_places(saves: DataFrame) -> DataFrame:
    """Some saves moved to places that are ignored in some projects, and to root files."""
    second = F.second("ts") % 7
    manifest = F.concat(
        F.lit('{"dependencies": {"express": "'), F.length("content"), F.lit('"}, "scripts": {"test": "x"}}')
    )
    moved = F.when(second == 1, F.concat(F.lit("docs/"), "path")).when(second == 2, "package.json")
    moved = moved.when(second == 3, "README.md").otherwise(F.col("path"))
    return saves.withColumns({"path": moved, "content": F.when(second == 2, manifest).otherwise(F.col("content"))})


# --- functions and sinks --------------------------------------------------------------------------------------


def redact_words(spark, sf_dir):
    """Every word of every document, masked as a secret would be."""
    words = corpus.documents(spark, sf_dir).select(F.explode(F.split("text", " ", -1)).alias("w"))
    return words.groupBy(T.redact(F.col("w")).alias("masked")).agg(F.count("*").alias("n"))


def trimmed_lines(spark, sf_dir):
    """Line splitting, trimming and clipping of every file; one row per distinct shown line."""
    lines = listing(spark, sf_dir).select(F.explode(T.split_lines(F.col("content"))).alias("line"))
    return lines.groupBy(T.clip(F.col("line")).alias("shown")).agg(
        F.count("*").alias("n"), F.sum(F.length(T.strip(F.col("line")))).alias("chars")
    )


def line_and_word_counts(spark, sf_dir):
    content = F.col("content")
    return listing(spark, sf_dir).select(
        "project_id",
        "path",
        T.line_count(content).alias("n_lines"),
        T.count_word(content, "any").cast("int").alias("any_count"),
        T.count_word(content, "de").cast("int").alias("de_count"),
    )


def result_json(spark, sf_dir):
    registry = default_registry()
    rows, facts = scan_findings(spark, sf_dir, keep=True)
    documents = result_documents(ctx.project_summary(facts, registry), rows, chunk=100)
    entries = F.from_json("document", "array<struct<order:int,id:string>>")
    score = F.get_json_object("document", "$.score").cast("int")
    return documents.select(
        "project_id",
        "part",
        F.when(F.col("part") == 0, score).alias("score"),
        F.when(F.col("part") > 0, F.size(entries)).alias("findings"),
        F.when(F.col("part") > 0, F.get(entries, 0)["id"]).alias("first_id"),
    )


def scan_capped(spark, sf_dir):
    """What a scan with a cap on files per project says it left out."""
    errors = scan(listing(spark, sf_dir), ScanConfig(root=sf_dir, max_files=CAP)).errors
    return errors.where("detector_id = 'reader'").select("project_id", "detector_id", "message")


QUERIES = {
    "scan_capped": scan_capped,
    "selected_files": selected_files,
    "gitignore_filter": gitignore_filter,
    "extra_excludes": extra_excludes,
    "capped_files": capped_files,
    "target_files": target_files,
    "file_classes": file_classes,
    "project_context": project_context,
    "d_secrets": _file_rule(
        "secret/hardcoded-api-key", "secret/hardcoded-jwt", "secret/hardcoded-credential"
    ),
    "d_env_not_ignored": _project_rule("secret/env-not-ignored"),
    "d_service_role": _file_rule("frontend_exposure/service-role-key"),
    "d_public_secret": _file_rule("frontend_exposure/public-secret-var"),
    "d_missing_auth": _file_rule("auth/missing-route-auth"),
    "d_missing_role": _file_rule("authorization/missing-role-check"),
    "d_missing_validation": _file_rule("validation/missing-body-validation"),
    "d_install_script": _project_rule("dependency/risky-install-script"),
    "d_excess_deps": _project_rule("dependency/excessive-dependencies"),
    "d_huge_file": _file_rule("code_quality/huge-file"),
    "d_empty_catch": _file_rule("code_quality/empty-catch"),
    "d_console_log": _file_rule("code_quality/console-log"),
    "d_excess_any": _project_rule("code_quality/excessive-any"),
    "d_localhost": _file_rule("code_quality/hardcoded-localhost"),
    "d_structure": _project_rule(
        "structure/missing-gitignore",
        "structure/missing-readme",
        "structure/missing-env-example",
        "structure/missing-tests",
    ),
    "detector_errors": errors_of_detectors,
    "all_findings": all_findings,
    "inline_ignores": stored_ignores,
    "min_severity": at_least_medium,
    "enabled_categories": some_categories,
    "enabled_by_project": categories_by_project,
    "pruned_scan": pruned_scan,
    "find_first": find_first,
    "score": project_scores,
    "score_from_findings": score_from_findings,
    "score_float_fold": score_float_fold,
    "summary": summary,
    "severity_share": severity_share,
    "decision": decision,
    "by_severity": by_severity,
    "worst_by_file": worst_by_file,
    "fleet_cube": fleet_cube,
    "repair_steps": repair_steps,
    "repair_plan": repair_plan,
    "top_steps": top_steps,
    "step_findings": step_findings,
    "by_file": by_file,
    "position_lookup": position_lookup,
    "within_document": within_document,
    "fixable": fixable,
    "fix_console_log": fix_console_log,
    "fix_env_example": fix_env_example,
    "example_texts": example_texts,
    "fix_gitignore": fix_gitignore,
    "fix_preview": fix_preview,
    "fix_results": fix_results,
    "apply_fix": apply_fix,
    "fix_verify": fix_verify,
    "scan_diff": scan_diff,
    "merge_findings": merge_findings,
    "rescan_scores": rescan_scores,
    "scan_configs": scan_configs,
    "custom_detectors": custom_detectors,
    "span_lookup": span_lookup,
    "tables_round_trip": tables_round_trip,
    "tree_round_trip": tree_round_trip,
    "debounce_saves": debounce_saves,
    "debounce_default": debounce_default,
    "stream_debounce": stream_debounce,
    "stream_scores": stream_scores,
    "redact": redact_words,
    "trimmed_lines": trimmed_lines,
    "line_and_word_counts": line_and_word_counts,
    "result_json": result_json,
}
