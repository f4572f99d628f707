"""Findings by place: per file, under a cursor, inside a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscan.functions.severity import editor_level
from fleetscan.functions.text import line_count
from fleetscan.operators.findings import order_struct
from fleetscan.plans.sizing import stored


def by_file(findings: DataFrame) -> DataFrame:
    """Located findings of each file, in line order. Bounded by the size of one file."""
    located = findings.where("file is not null and line is not null")
    entry = F.struct("line", "rule_ord", "rule_id", "id", editor_level(F.col("severity")).alias("level"))
    return located.groupBy("project_id", "file").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(entry)).alias("marks")
    )


#: Levels of blocks that spans of lines are made of: a block of level n has 2**n lines.
LEVELS = 31


def blocks_of(start: Column, end: Column) -> Column:
    """The span ``start`` to ``end`` (0-based, both included) as an array of ``level, block``: the
    fewest aligned blocks of 2**level lines, at most two of each level."""

    def step(state: Column, level: Column) -> Column:
        low, high = state["low"], state["high"]
        some = low <= high
        left = some & (low % 2 == 1)
        # a span of one block that the left end takes is used up
        right = some & (high % 2 == 0) & ~(left & (low == high))
        none = F.array().cast("array<struct<level:int,block:bigint>>")

        def halved(end: Column, taken: Column, by: int) -> Column:
            inner = F.floor(F.when(taken, end + by).otherwise(end) / 2).cast("bigint")
            return F.when(some, inner).otherwise(end)

        def one(when: Column, block: Column) -> Column:
            entry = F.struct(level.cast("int").alias("level"), block.alias("block"))
            return F.when(when, F.array(entry)).otherwise(none)

        return F.struct(
            halved(low, left, 1).alias("low"),
            halved(high, right, -1).alias("high"),
            F.concat(state["out"], one(left, low), one(right, high)).alias("out"),
        )

    first = F.struct(
        start.cast("bigint").alias("low"),
        end.cast("bigint").alias("high"),
        F.array().cast("array<struct<level:int,block:bigint>>").alias("out"),
    )
    many = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), first, step, lambda s: s["out"])
    single = F.array(F.struct(F.lit(0).alias("level"), start.cast("bigint").alias("block")))
    return F.when(start == end, single).otherwise(many)


def covered_blocks(findings: DataFrame) -> DataFrame:
    """For every block of lines (0-based) that is a part of a finding's span, the first such
    finding in output order: ``project_id, file, level, block, key, hit``.

    A finding covers ``line`` to ``end_line``; without an end just ``line``, without a line
    the first one. A span of n lines is at most 2 * log2(n) rows, and looking positions up is a
    plain equi-join: it never pairs all findings of a file with all positions in it.
    """
    zero = F.lit(0)
    start = F.greatest(zero, F.coalesce("line", F.lit(1)) - 1)
    end = F.greatest(zero, F.coalesce("end_line", "line", F.lit(1)) - 1)
    spans = findings.where("file is not null").withColumn("key", order_struct())
    places = spans.where(start <= end).withColumn("at", F.explode(blocks_of(start, end)))
    hit = F.struct("id", "rule_id", "severity", "title")
    return places.groupBy("project_id", "file", F.col("at.level").alias("level"), F.col("at.block").alias("block")).agg(
        F.min(F.struct("key", hit.alias("hit"))).alias("first")
    )


def position_lookup(findings: DataFrame, positions: DataFrame) -> DataFrame:
    """``positions(project_id, path, pos)``, 0-based, to the finding under each: of all whose
    span holds it, the first in output order."""
    index = stored(covered_blocks(findings)).withColumnRenamed("file", "path")
    # a number for each level that there is, 32 at most
    levels = sorted(r.level for r in index.select("level").distinct().collect())
    if not levels:
        levels = [0]
    level = F.explode(F.array(*[F.lit(n) for n in levels]))
    keyed = positions.select("project_id", "path", "pos").distinct().withColumn("level", level)
    keyed = keyed.withColumn("block", F.floor(F.col("pos") / F.pow(F.lit(2.0), F.col("level"))))
    met = keyed.join(index, ["project_id", "path", "level", "block"])
    found = met.groupBy("project_id", "path", "pos").agg(F.min("first").alias("first"))
    out = positions.join(found, ["project_id", "path", "pos"])
    return out.select("project_id", "path", "pos", "first.hit.*")


def within_document(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Located findings whose line exists in the current text of the file."""
    lengths = files.select(
        "project_id", F.col("path").alias("file"), line_count(F.col("content")).alias("n_lines")
    )
    located = findings.where("line >= 1").join(lengths, ["project_id", "file"])
    return located.where(F.col("line") <= F.col("n_lines")).select(*findings.columns)
