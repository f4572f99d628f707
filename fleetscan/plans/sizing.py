"""Plan choices that depend on measured sizes, and where intermediate tables go."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_WEIGHT = 5_000_000
# Keys whose 64-bit hashes may be broadcast.
BROADCAST_HASHES = 4_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weigh: Column | None = None) -> bool:
    """Measured, not guessed: are there at most ``rows`` rows, and does ``weigh`` (say, the
    size of an array) add up to at most ``BROADCAST_WEIGHT`` over them?"""
    if weigh is None:
        return df.limit(rows + 1).count() <= rows
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(weigh), F.lit(0)).alias("w")).first()
    return total.n <= rows and total.w <= BROADCAST_WEIGHT


def broadcast_if_small(
    df: DataFrame, rows: int = BROADCAST_ROWS, weigh: Column | None = None
) -> DataFrame:
    """A broadcast hint behind a size check; a larger side stays with the optimizer's choice.
    Give ``weigh`` for rows that are not of a fixed width."""
    return F.broadcast(df) if small(df, rows, weigh) else df


def small_side(
    df: DataFrame, rows: int = BROADCAST_ROWS, weigh: Column | None = None
) -> DataFrame:
    """The small side of a join, when computing it is costly: stored once, measured on the
    stored table, and hinted for broadcast if it is as small as expected."""
    return broadcast_if_small(stored(df), rows, weigh)


def parted(
    rows: DataFrame, keys: DataFrame, on: list[str], weigh: Column | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` that may have a partner in ``keys`` by ``on``, and those that surely have none.

    For joins of contents with a table too large to be broadcast itself: hashes of its keys tell
    most rows apart where they are, so that what has no partner never moves. A table that is small
    (``weigh`` as in :func:`small`), or has more keys than may be broadcast as hashes, leaves all rows
    in the first part; the second is None. ``keys`` is counted, so it should be a stored table.
    """
    if small(keys, weigh=weigh) or not small(keys, BROADCAST_HASHES):
        return rows, None
    hashes = F.broadcast(keys.select(F.xxhash64(*on).alias("key_hash")).distinct())
    same = F.xxhash64(*[rows[c] for c in on]) == hashes["key_hash"]
    return rows.join(hashes, same, "left_semi"), rows.join(hashes, same, "left_anti")


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The ``rows`` with a partner among ``keys``: the others stay where they are (:func:`parted`)."""
    return parted(rows, keys, on)[0].join(broadcast_if_small(keys.select(*on)), on, "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a scan that arrives in fewer pieces than there are cores.

    Only small inputs are affected: a large table has more splits than the cluster has
    cores and is left alone, so no shuffle of its contents takes place. ``df`` must be a
    plain scan (its partitions are counted without running anything).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


_chosen: list[str] = []


def use_folder(path: str | None) -> None:
    """Name the folder for intermediate tables where the session's configuration names none. All
    executors must reach it, and whoever names it removes what is written there."""
    _chosen[:] = [path] if path else []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, else the one given to
    :func:`use_folder`. There is no default: a folder of one machine would lose tables."""
    named = spark.conf.get("spark.checkpoint.dir", None) or next(iter(_chosen), None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return named.rstrip("/")


_own: list[str] = []


def own_folder(spark: SparkSession) -> None:
    """Where the session names no folder for intermediate tables: one of its own for a session
    that is a single process, removed when that ends. Tests and trials call this; on a cluster it
    does nothing."""
    master = spark.sparkContext.master
    if spark.conf.get("spark.checkpoint.dir", None) or not re.fullmatch(r"local(\[.*\])?", master):
        return
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="fleetscan-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    use_folder(_own[0])


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table: what follows is
    computed from it as often as needed, and survives the loss of executors."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
