"""S3: a fleet that is already in a table, the usual case at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscan.functions.paths import normalise
from fleetscan.plans.sizing import spread

FILE_SCHEMA = "project_id string, path string, content string"


def read_corpus(spark: SparkSession, path: str, schema: str = FILE_SCHEMA) -> DataFrame:
    """Read ``project_id, path, content`` from Parquet with a declared schema."""
    rows = spread(spark.read.schema(schema).parquet(path))
    return rows.withColumn("path", normalise(F.col("path"))).fillna("", ["content"])
