"""What the operators of this package share: tables, stored intermediate results, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscan.plans import sizing

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A session that is one process and names no folder gets one for its own
    lifetime; on a cluster that stays an error."""
    sizing.own_folder(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: that of ``spark.checkpoint.dir``, or the one that the
    caller named."""
    return sizing.shared_folder(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table. It is computed once,
    survives lost executors, and its lineage ends here."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts that are in one Arrow batch, where the session keeps Spark's default of 10,000.
BATCH_TEXTS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a thousand at a time, so that neither they nor the JVM hold
    more; a session that has its own setting keeps it."""
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, str(BATCH_TEXTS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column) -> Column:
    """0 for held-out documents, 1 to 4 for those that may be learned from; null ids are held
    out, since nothing says that they are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def column(batch: pa.RecordBatch, name: str) -> list:
    return column_of(batch, name).to_pylist()


def rows_to_batches(
    rows: Iterable[tuple], schema: pa.Schema, most_rows: int = 8192, most_bytes: int = 1 << 23
) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size from an iterator of (bytes it holds, row) pairs."""
    held, size = [], 0
    for weight, row in rows:
        held.append(row)
        size += weight
        if len(held) >= most_rows or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def summed_arrays(parts: DataFrame, dtype: str, how: str = "sum") -> DataFrame:
    """Sums (or bitwise ``or``) by key of rows (key string, data binary), where data is a buffer of
    ``dtype``. Keys are dealt out and added up as they stream in, one buffer for each in a task."""

    def add(batches):
        import numpy as np

        held: dict = {}
        for batch in batches:
            for key, data in zip(column(batch, "key"), column(batch, "data")):
                part = np.frombuffer(data, dtype)
                if key in held:
                    held[key] = held[key] | part if how == "or" else held[key] + part
                else:
                    held[key] = part.copy()
        for key, total in held.items():
            yield pa.RecordBatch.from_pydict({"key": [key], "data": [total.tobytes()]})

    return parts.repartition(shuffle_partitions(parts.sparkSession), "key").mapInArrow(
        add, "key string, data binary"
    )
