"""Connected components of a table of links, and groups cut into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b; longs) reaches.

    Every round, a node takes the smallest label among its own, its neighbours', and that of the
    node its label names, so chains shorten to a fraction. Each round is a written table. Labels
    never leave the executors; a node with very many neighbours is a skewed side of a join, which
    adaptive execution splits.
    """
    pairs = edges.filter("a <> b").select("a", "b")
    both = stored(pairs.union(pairs.select("b", "a")).distinct(), "links")
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("component")
        ),
        "labels",
    )
    while True:
        known = labels.select(F.col("node").alias("k"), F.col("component").alias("k_label"))
        near = (
            both.join(known, F.col("b") == F.col("k"))
            .groupBy(F.col("a").alias("n"))
            .agg(F.min("k_label").alias("near"))
        )
        hooked = labels.join(near, F.col("node") == F.col("n")).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("to")
        )
        moved = stored(
            hooked.join(known, F.col("to") == F.col("k")).select(
                "node",
                F.least("to", "k_label").alias("component"),
                (F.least("to", "k_label") < F.col("old")).alias("changed"),
            ),
            "labels",
        )
        labels = moved.select("node", "component")
        if moved.filter("changed").limit(1).count() == 0:
            return labels


def in_blocks(members: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """Rows of ``members`` for every task that compares members of a group, with the columns
    lo, hi and part.

    A group of at most ``block`` members is one task (0, 0). A larger one is cut into parts by a
    hash of the node; each two parts are a task (lo, hi), and each part with itself. Groups of one
    member go.
    """
    counts = members.groupBy(F.col(key).alias("c_key")).agg(F.count(F.lit(1)).alias("c_n")).filter("c_n > 1")
    parts = F.ceil(F.col("c_n") / block).cast("int")
    part = F.pmod(F.xxhash64(node), parts).cast("int")
    return (
        members.join(counts, F.col(key) == F.col("c_key"))
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
        .drop("c_key", "c_n", "other")
    )


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows of each task of :func:`in_blocks` together, one task after the other."""
    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def tasks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The dealt rows as one table per task."""
    names, held, last = (key, "lo", "hi"), [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            now = tuple(marks[:, a])
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's component, from a symmetric matrix of links."""
    n = len(linked)
    label = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new
