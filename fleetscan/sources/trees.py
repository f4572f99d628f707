"""Reading project directories, dotfiles included, as a Spark data source.

Spark's own file sources skip names that start with a dot or an underscore, which would
lose ``.env`` and ``.gitignore``. This one lists ``root/<project>/...``, on a file system that all
executors see; contents are read from the listing afterwards, in parts of like size.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fleetscan.functions.paths import normalise
from fleetscan.plans.sizing import stored
from fleetscan.values import EXCLUDED_DIRS

SCHEMA = "project_id string, path string, bytes binary, skipped string"
NAMES = "project_id string, path string, size bigint, changed timestamp, skipped string"
BATCH_BYTES = 16 << 20
#: Bytes and files that one task reads, about.
PART_BYTES = 64 << 20
PART_FILES = 10_000


#: Listing tasks there are at least, if there are that many directories, and directories in each.
LIST_TASKS = 64
LIST_ENTRIES = 1000


class TreePart(InputPartition):
    """Some (project, entry) of projects' root directories; an empty entry stands for the files
    in the root itself."""

    def __init__(self, entries: list[tuple[str, str]]):
        super().__init__(entries)
        self.entries = entries


class TreeNames(DataSourceReader):
    """The names of files, not their contents. The driver lists two levels; everything below is
    listed in tasks, so a project may be many tasks."""

    def __init__(self, options):
        self.root = options["path"]
        limit = options.get("maxbytes")
        self.max_bytes = int(limit) if limit else None
        self.follow = options.get("followlinks", "true").lower() == "true"

    def partitions(self):
        parts = []
        for project in sorted(os.scandir(self.root), key=lambda e: e.name):
            if not project.is_dir():
                continue
            parts.append((project.name, ""))
            for entry in sorted(os.scandir(project.path), key=lambda e: e.name):
                if entry.is_dir(follow_symlinks=self.follow) and entry.name not in EXCLUDED_DIRS:
                    parts.append((project.name, entry.name))
        tasks = max(LIST_TASKS, -(-len(parts) // LIST_ENTRIES))
        return [TreePart(parts[k::tasks]) for k in range(min(tasks, len(parts)))] or [TreePart([])]

    def _paths(self, base: str, entry: str):
        if not entry:
            for e in os.scandir(base):
                if e.is_file():
                    yield e.name
            return
        seen = set()
        for folder, dirs, names in os.walk(os.path.join(base, entry), followlinks=self.follow):
            real = os.path.realpath(folder)
            if real in seen:
                dirs[:] = []
                continue
            seen.add(real)
            dirs[:] = sorted(d for d in dirs if d not in EXCLUDED_DIRS)
            for name in sorted(names):
                full = os.path.join(folder, name)
                if os.path.isfile(full):
                    yield os.path.relpath(full, base)

    def read(self, partition):
        rows = []
        for project, entry in partition.entries:
            base = os.path.join(self.root, project)
            for path in self._paths(base, entry):
                try:
                    about = os.stat(os.path.join(base, path))
                    size, changed = about.st_size, about.st_mtime_ns // 1000
                except OSError:
                    size, changed = 0, None
                skipped = None
                if self.max_bytes is not None and size > self.max_bytes:
                    skipped = f"larger than {self.max_bytes} bytes"
                rows.append((project, path, size, changed, skipped))
                if len(rows) >= PART_FILES:
                    yield _names(rows)
                    rows = []
        if rows:
            yield _names(rows)


def _names(rows) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
        names=["project_id", "path", "size", "changed", "skipped"],
    )


class TreeSource(DataSource):
    """``spark.read.format("project_tree_names").load(root)``; options ``maxBytes``, ``followLinks``."""

    @classmethod
    def name(cls):
        return "project_tree_names"

    def schema(self):
        return NAMES

    def reader(self, schema):
        return TreeNames({k.lower(): v for k, v in self.options.items()})


def list_trees(
    spark: SparkSession, root: str, max_bytes: int | None = None, follow_links: bool = True
) -> DataFrame:
    """The files of all project directories below ``root``: ``project_id, path, size, changed,
    skipped``; the last says why a file is to be left out, if it is."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("project_tree_names").option("followLinks", str(follow_links).lower())
    if max_bytes is not None:
        reader = reader.option("maxBytes", str(max_bytes))
    return reader.load(root)


def read_listed(names: DataFrame, root: str) -> DataFrame:
    """S1 for a listing, or a part of one: the bytes of its files and of no others.

    The listing is stored and dealt out anew, by a hash of the names, to as many tasks as its bytes
    and files ask for, so one directory of very many files is read by many tasks.
    """
    listed = stored(names.select("project_id", "path", "size", "skipped"))
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    parts = max(1, -(-total.size // PART_BYTES), -(-total.n // PART_FILES))
    base = root

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for project, path, skipped in zip(*(batch.column(n).to_pylist() for n in ("project_id", "path", "skipped"))):
                data = b""
                if skipped is None:
                    try:
                        with open(os.path.join(base, project, path), "rb") as f:
                            data = f.read()
                    except OSError:
                        data = b""  # an unreadable file counts as empty
                rows.append((project, path, data, skipped))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    spread = listed.repartition(parts, F.xxhash64("project_id", "path")) if parts > 1 else listed.coalesce(1)
    return spread.mapInArrow(read, SCHEMA)


def _batch(rows) -> pa.RecordBatch:
    project, path, data, skipped = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(project, pa.string()),
            pa.array(path, pa.string()),
            pa.array(data, pa.binary()),
            pa.array(skipped, pa.string()),
        ],
        names=["project_id", "path", "bytes", "skipped"],
    )


def read_trees(
    spark: SparkSession,
    root: str,
    max_bytes: int | None = None,
    follow_links: bool = True,
    only: Column | None = None,
) -> DataFrame:
    """The files of all project directories below ``root``, as bytes. ``only`` is a condition on
    ``project_id``, ``path``, ``size`` and ``changed``; files that do not meet it are not opened."""
    names = list_trees(spark, root, max_bytes, follow_links)
    return read_listed(names if only is None else names.where(only), root)


def decode(raw: DataFrame) -> DataFrame:
    """Bytes to text. Bytes that are not UTF-8 are replaced, absent ones give an empty
    text; paths get forward slashes. ``skipped`` goes along: a scan leaves such files out."""
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    return raw.select(
        "project_id",
        normalise(F.col("path")).alias("path"),
        F.coalesce(text, F.lit("")).alias("content"),
        "skipped",
    )


def skipped_files(raw: DataFrame) -> DataFrame:
    """Files left out for their size, as detector errors."""
    return raw.where("skipped is not null").select(
        "project_id",
        F.lit("reader").alias("detector_id"),
        F.lit("File reader").alias("detector_name"),
        F.concat("path", F.lit(": "), "skipped").alias("message"),
    )
