"""Keeping results current while files are saved.

Saves are debounced per file, each micro-batch scans only the saved files, and their projects are
scored again from sums: what the earlier versions added is taken away, what the new ones add put in
its place. State is a set of tables in a shared folder, kept in a few layers whatever the number of
batches; a batch counts with one commit, and one that is repeated changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetscan import values as V
from fleetscan.functions import paths as P
from fleetscan.operators.context import (
    CONTEXT_COLUMNS,
    ROOT_FILES,
    added,
    combined,
    contributions,
    facts_of,
    project_summary,
)
from fleetscan.operators.findings import describe, file_hits, project_hits
from fleetscan.operators.gitignore import file_rule_sets, with_ignored_by_sets
from fleetscan.operators.observe import DEFAULT_IGNORE_PREFIX, observe
from fleetscan.operators.selection import selectable
from fleetscan.plans.sizing import broadcast_if_small, stored
from fleetscan.rules.builtin import default_registry
from fleetscan.rules.model import Registry
from fleetscan.streaming.layers import BASE, Layers

BUCKETS = 256
SEED = -1


def code_saves(saves: DataFrame) -> DataFrame:
    """Only saves of script files trigger a scan."""
    return saves.where(P.is_code(F.col("path")))


def debounce(saves: DataFrame, gap: str = V.DEBOUNCE) -> DataFrame:
    """Saves of a file that follow each other within ``gap`` count as one, the last.

    Works on batches and on streams. A stream needs a watermark on ``ts``; a session comes
    out once the watermark has passed its end, and saves older than that are dropped (the
    next full scan covers them). Sessions are per file, so no file delays another.
    """
    session = F.session_window("ts", gap)
    return (
        saves.groupBy("project_id", "path", session.alias("session"))
        .agg(
            F.max_by("content", "ts").alias("content"),
            F.max("ts").alias("saved_at"),
            F.count("*").alias("saves"),
        )
        .select("project_id", "path", "content", "saved_at", "saves")
    )


def watched(saves: DataFrame) -> DataFrame:
    """Saves that change results: of script files, and of the files that a project's context and
    ignore rules come from, which every scan reads anew."""
    path = F.col("path")
    context = [p for paths in ROOT_FILES.values() for p in paths]
    return saves.where(P.is_code(path) | P.is_manifest(path) | path.isin(*context))


def _latest_of(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of the highest batch of each key."""
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"], "left_semi")


def _latest_files(rows: DataFrame) -> DataFrame:
    """Rows of the last scan of each file; every scan of a file left one file row."""
    last = rows.where("rule_no = 0").groupBy("project_id", "path")
    last = last.agg(F.max("batch").alias("batch"))
    return rows.join(last, ["project_id", "path", "batch"], "left_semi")


def _latest_projects(rows: DataFrame) -> DataFrame:
    return _latest_of(rows, "project_id")


class IncrementalScan:
    """Scan state in a folder, as :class:`Layers` of four tables: observations of files, the sums
    they add to their projects, the projects' results, and ignore files.

    A batch reads the stored rows of the files it brings and the sums of their projects, never
    contents and never the other files.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        registry: Registry | None = None,
        ignore_prefix: str = DEFAULT_IGNORE_PREFIX,
        buckets: int = BUCKETS,
        ignore_case: bool = True,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.registry = registry or default_registry()
        self.ignore_prefix = ignore_prefix
        self.ignore_case = ignore_case
        self.buckets = buckets
        merges = {
            "observations": _latest_files,
            "parts": added,
            "projects": _latest_projects,
            "ignores": _latest_projects,
        }
        self.layers = Layers(spark, path, merges, buckets)

    def seed(self, observations: DataFrame, files: DataFrame | None = None) -> None:
        """Start from a full scan's observations. ``files``, the listing that was scanned, gives the
        ignore files by which saves are judged."""
        if "saved_at" not in observations.columns:
            observations = observations.withColumn("saved_at", F.lit(None).cast("timestamp"))
        rows = observations.withColumn("batch", F.lit(SEED).cast("bigint"))
        if files is None:
            ignores = self.spark.createDataFrame([], "project_id string, content string")
        else:
            ignores = files.where("path = '.gitignore'").select("project_id", "content")
        self._start(rows, ignores.withColumn("batch", F.lit(SEED).cast("bigint")))

    def _start(self, observations: DataFrame, ignores: DataFrame) -> None:
        write, layer = self.layers.write, self.layers.layer
        written = {"observations": write("observations", "seed", observations)}
        rows = layer("observations", written["observations"])
        written["parts"] = write("parts", "seed", contributions(rows, self.registry))
        results = self._summaries(layer("parts", written["parts"]).drop("bucket"))
        written["projects"] = write("projects", "seed", results.withColumn("batch", F.lit(SEED).cast("bigint")))
        written["ignores"] = write("ignores", "seed", ignores)
        self.layers.commit(SEED, written, BASE)

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        """At most ``buckets`` numbers come to the driver; they prune what is read."""
        return [r.b for r in rows.select(self.layers.bucket().alias("b")).distinct().collect()]

    def _of(self, table: str, projects: DataFrame | None) -> DataFrame:
        if projects is None:
            return self.layers.read(table)
        rows = self.layers.read(table, self._buckets_of(projects))
        return rows.join(broadcast_if_small(projects), "project_id", "left_semi")

    def observations(self, projects: DataFrame | None = None) -> DataFrame:
        """Current observations, of some projects or of all."""
        return _latest_files(self._of("observations", projects)).drop("batch", "bucket", "saved_at")

    def findings(self, projects: DataFrame | None = None) -> DataFrame:
        """Current findings, in full: those of rescanned files replaced, project level anew."""
        facts = facts_of(combined(self._of("parts", projects).drop("bucket")), self.registry)
        hits = file_hits(self.observations(projects)).unionByName(project_hits(facts, self.registry))
        return describe(hits, self.registry)

    def projects(self) -> DataFrame:
        """The latest score, summary and context of every project."""
        return _latest_projects(self.layers.read("projects")).drop("batch", "bucket")

    def _summaries(self, parts: DataFrame) -> DataFrame:
        rows = project_summary(facts_of(parts, self.registry), self.registry)
        numbers = [f"n_{x}" for x in V.SEVERITIES + V.CATEGORIES]
        return rows.select(
            "project_id", "score", "deploy_status", "exit_code", "total", *numbers,
            "files_scanned", "lines_scanned", *CONTEXT_COLUMNS,
        )

    def apply(self, saved: DataFrame, batch: int) -> None:
        """T4 and T5: scan the saved files and bring their projects up to date. ``saved`` has
        ``project_id, path, content`` and, if saves may come out of order, ``saved_at``.

        A batch that counts already changes nothing. Saves in excluded or ignored places are known
        as files and not looked at, by the ignore file that is newest for the project. A save of
        an ignore file counts for the saves of its batch and later ones; files scanned before
        keep their state until the next full scan.
        """
        if batch <= self.layers.batch():
            return
        if "saved_at" not in saved.columns:
            saved = saved.withColumn("saved_at", F.lit(None).cast("timestamp"))
        place = ["project_id", "path"]
        # the last save of each file; of one time, the largest text, so that a replay agrees
        last = stored(
            saved.groupBy(*place).agg(F.max(F.struct("saved_at", "content")).alias("last")).select(
                *place, "last.content", "last.saved_at"
            )
        )
        buckets = self._buckets_of(last)
        if not buckets:
            return
        touched = broadcast_if_small(last.select(*place))
        known = self.layers.read("observations", buckets).join(touched, place, "left_semi")
        known = stored(_latest_files(known).drop("bucket"))
        # a save that comes late is not lost and undoes nothing
        times = known.where("rule_no = 0").select(*place, F.col("saved_at").alias("known_at"))
        newer = F.col("known_at").isNull() | F.col("saved_at").isNull() | (F.col("saved_at") >= F.col("known_at"))
        last = stored(last.join(times, place, "left").where(newer).drop("known_at"))
        ignores = last.where("path = '.gitignore'").select(
            "project_id", "content", F.lit(batch).cast("bigint").alias("batch")
        )
        projects = broadcast_if_small(last.select("project_id").distinct())
        held = self.layers.read("ignores", buckets).drop("bucket").join(projects, "project_id", "left_semi")
        current = _latest_projects(held.unionByName(ignores)).withColumn("path", F.lit(".gitignore"))
        marked = with_ignored_by_sets(last, file_rule_sets(current, self.ignore_case), self.ignore_case)
        marked = marked.withColumn("selected", selectable(self.ignore_case) & ~F.col("ignored"))
        rows = observe(marked.drop("ignored", "saved_at"), self.registry, self.ignore_prefix)
        rows = rows.join(last.select(*place, "saved_at"), place, "left")
        write, layer = self.layers.write, self.layers.layer
        written = {
            "observations": write("observations", f"b{batch}", rows.withColumn("batch", F.lit(batch).cast("bigint")))
        }
        new = layer("observations", written["observations"])
        replaced = known.join(broadcast_if_small(last.select(*place)), place, "left_semi")
        change = contributions(replaced, self.registry, -1).unionByName(contributions(new, self.registry))
        written["parts"] = write("parts", f"b{batch}", added(change))
        sums = self.layers.read("parts", buckets).unionByName(layer("parts", written["parts"])).drop("bucket")
        sums = combined(sums.join(projects, "project_id", "left_semi"))
        results = self._summaries(sums).withColumn("batch", F.lit(batch).cast("bigint"))
        written["projects"] = write("projects", f"b{batch}", results)
        if not ignores.isEmpty():
            written["ignores"] = write("ignores", f"b{batch}", ignores)
        self.layers.commit(batch, written)

    def start(
        self, saves: DataFrame, checkpoint: str, **trigger
    ) -> StreamingQuery:
        """Run on a stream of ``project_id, path, content, ts``. Micro-batches are serial by
        nature (T3); a failing batch fails the query. ``trigger`` as for ``writeStream``; saves of a
        file within one trigger count as one, the last. No save waits for a watermark and
        none is dropped for being late."""
        return _started(watched(saves).withColumnRenamed("ts", "saved_at"), self.apply, checkpoint, trigger)

    def compact(self, path: str) -> IncrementalScan:
        """The current state as the seed of a new folder, to be continued there."""
        fresh = IncrementalScan(
            self.spark, path, self.registry, self.ignore_prefix, self.buckets, self.ignore_case
        )
        seed = F.lit(SEED).cast("bigint")
        observations = _latest_files(self.layers.read("observations")).withColumn("batch", seed)
        ignores = _latest_projects(self.layers.read("ignores")).withColumn("batch", seed)
        fresh._start(observations, ignores)
        return fresh


def _started(rows: DataFrame, apply, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        rows.writeStream.outputMode("append")
        .foreachBatch(lambda part, batch: apply(part, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def merged_sessions(parts: DataFrame, gap: str = V.DEBOUNCE) -> DataFrame:
    """Parts of sessions (first_at, saved_at, saves, content) that lie within ``gap`` of each other, as
    one. Parts may be merged in any order and number, so a session needs no end to be known."""
    by_file = Window.partitionBy("project_id", "path").orderBy("first_at", "saved_at")
    before = F.max("saved_at").over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    begins = before.isNull() | (F.col("first_at") > before + F.expr(f"INTERVAL {gap}"))
    numbered = parts.withColumn("begins", begins.cast("int")).withColumn("session", F.sum("begins").over(by_file))
    return numbered.groupBy("project_id", "path", "session").agg(
        F.max_by("content", "saved_at").alias("content"),
        F.min("first_at").alias("first_at"),
        F.max("saved_at").alias("saved_at"),
        F.sum("saves").alias("saves"),
    ).drop("session")


class SessionLog:
    """T2 on a stream that may end, stop and go on: every save counts, however late, and a session
    that is still open is a result like any other.

    Each batch adds its own sessions as a layer and reads nothing; layers are merged by and by.
    """

    def __init__(self, spark: SparkSession, path: str, gap: str = V.DEBOUNCE, buckets: int = BUCKETS):
        self.gap = gap
        self.layers = Layers(spark, path, {"sessions": lambda rows: merged_sessions(rows, gap)}, buckets)

    def apply(self, saves: DataFrame, batch: int) -> None:
        """Take up saves (``project_id, path, content, ts``). A batch that counts already changes
        nothing."""
        if batch <= self.layers.batch():
            return
        parts = saves.select(
            "project_id", "path", "content", F.col("ts").alias("first_at"), F.col("ts").alias("saved_at"),
            F.lit(1).cast("bigint").alias("saves"),
        )
        self.layers.commit(batch, {"sessions": self.layers.write("sessions", f"b{batch}", merged_sessions(parts, self.gap))})

    def start(self, saves: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run on a stream; arguments as for :meth:`IncrementalScan.start`."""
        return _started(code_saves(saves), self.apply, checkpoint, trigger)

    def sessions(self) -> DataFrame:
        """All sessions up to now: ``project_id, path, content, saved_at, saves``."""
        rows = merged_sessions(self.layers.read("sessions").drop("bucket"), self.gap)
        return rows.select("project_id", "path", "content", "saved_at", "saves")
