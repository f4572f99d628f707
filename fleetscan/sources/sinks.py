"""K1 and K2: results as JSON documents and as partitioned tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscan import values as V
from fleetscan.operators.context import CONTEXT_COLUMNS
from fleetscan.operators.repair import ordered
from fleetscan.sources.commits import Commits


def result_documents(
    projects: DataFrame, findings: DataFrame, timestamp: str | None = None, chunk: int = 1000
) -> DataFrame:
    """One JSON document per project with its score, context and summary (part 0), followed
    by its findings in output order, ``chunk`` to a document. A project of any size is whole
    in the output and never whole in one row."""
    heads = projects.select(
        "project_id",
        F.lit(0).alias("part"),
        F.to_json(
            F.struct(
                F.lit(timestamp).alias("timestamp"),
                F.col("project_id").alias("projectPath"),
                "score",
                F.col("deploy_status").alias("deployStatus"),
                F.struct(
                    F.col("total").alias("totalFindings"),
                    *[F.col(f"n_{s}").alias(f"{s}Count") for s in V.SEVERITIES],
                    F.col("category_counts").alias("categoryCounts"),
                    F.col("files_scanned").alias("filesScanned"),
                    F.col("lines_scanned").alias("linesScanned"),
                ).alias("summary"),
                F.struct(*CONTEXT_COLUMNS).alias("projectContext"),
            )
        ).alias("document"),
    )
    public = [
        "order", "id", "rule_id", "title", "severity", "category", "deploy_blocking", "confidence",
        "file", "line", "evidence", "plain_english_problem", "why_it_matters", "fix_steps",
        "auto_fix_available", "ai_fix_prompt",
    ]
    rows = ordered(findings)
    part = (F.floor((F.col("order") - 1) / chunk) + 1).cast("int")
    parts = rows.groupBy("project_id", part.alias("part")).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(*public)))).alias("document")
    )
    return heads.unionByName(parts)


def write_documents(documents: DataFrame, path: str) -> None:
    """Line-delimited JSON: every line is one document with its project and part."""
    documents.write.mode("overwrite").json(path)


TABLES = ("findings", "steps", "projects", "errors")


def write_tables(tables, path: str, scan_date: str) -> None:
    """Findings, steps, scores and errors as Parquet, published together as those of a scan date.

    The four are written to a folder of their own; a commit makes them the date's tables. If a
    write fails, the date stays as it was. Writing a date again replaces that date only; folders
    that no date names any more are left for :func:`vacuum`.
    """
    folder = f"data/{scan_date}-{uuid.uuid4().hex}"
    schemas = {}
    for name in TABLES:
        rows = getattr(tables, name).withColumn("scan_date", F.lit(scan_date).cast("date"))
        schemas[name] = rows.schema.json()
        rows.write.parquet(f"{path}/{folder}/{name}")
    commits = Commits(rows.sparkSession, f"{path}/commits")
    number, document = commits.read()
    dates = {**document.get("dates", {}), scan_date: {"folder": folder, "schemas": schemas}}
    unused = [d["folder"] for d in document.get("dates", {}).values() if d not in dates.values()]
    commits.write(number, {"dates": dates, "unused": [*document.get("unused", []), *unused]})


def read_tables(spark: SparkSession, path: str, name: str, dates: list[str] | None = None) -> DataFrame:
    """One of :data:`TABLES` over the published scan dates, or some of them."""
    published = Commits(spark, f"{path}/commits").read()[1].get("dates", {})
    out = None
    for date in sorted(published) if dates is None else dates:
        schema = StructType.fromJson(json.loads(published[date]["schemas"][name]))
        rows = spark.read.schema(schema).parquet(f"{path}/{published[date]['folder']}/{name}")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no scan is published in {path}")
    return out


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove folders of replaced dates, once nobody reads them any more; how many."""
    commits = Commits(spark, f"{path}/commits")
    number, document = commits.read()
    unused = document.get("unused", [])
    if unused:
        commits.write(number, {**document, "unused": []})
        for folder in unused:
            commits.remove(f"{path}/{folder}")
    return len(unused)
