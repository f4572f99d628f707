"""Tables that grow by batches and are read as a few layers.

Each batch adds one layer to a table. When a tier has ``FAN`` layers, they are merged into one of
the next tier, so a table of n batches has at most ``(FAN - 1) * log(n) / log(FAN)`` layers besides the
one it started from, and each row is merged that many times at most. Layers are cut into buckets by
project. A commit names the live layers of all tables, with their schemas: nothing is listed or
inferred to find them, and a batch counts with all its tables or not at all.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscan.sources.commits import Commits

FAN = 8
#: The tier of layers that a table starts from; they are not merged with others.
BASE = 1 << 20
NO_BATCH = -1


class Layers:
    """``merges`` says for each table how rows of several layers become one layer's."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        merges: dict[str, Callable[[DataFrame], DataFrame]],
        buckets: int,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.merges = merges
        self.buckets = buckets
        self._commits = Commits(spark, f"{self.path}/commits")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("project_id"), F.lit(self.buckets)).cast("int")

    def batch(self) -> int:
        """The last batch that counts."""
        return self._commits.read()[1].get("batch", NO_BATCH)

    def folders(self, table: str) -> list[str]:
        """The live layers of a table."""
        return [x["folder"] for x in self._commits.read()[1].get("layers", {}).get(table, [])]

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """All rows of a table's live layers, of some buckets only. What they mean together is the
        table's merge."""
        document = self._commits.read()[1]
        return self._rows(document, table, self.folders(table), buckets)

    def _rows(self, document, table, folders, buckets=None) -> DataFrame:
        rows = self._at(table, document["schemas"][table], folders)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _at(self, table: str, schema: dict, folders: list[str]) -> DataFrame:
        kind = StructType.fromJson(schema).add("layer", "string")
        reader = self.spark.read.schema(kind).option("basePath", f"{self.path}/{table}")
        return reader.parquet(*[f"{self.path}/{f}" for f in folders]).drop("layer")

    def write(self, table: str, name: str, rows: DataFrame) -> tuple[str, str]:
        """Write a layer that does not count yet; its folder and schema. Writing it again, after a
        failure, replaces it."""
        folder = f"{table}/layer={name}"
        rows = rows.drop("bucket").withColumn("bucket", self.bucket())
        # few files for each bucket, and several where a project is huge
        writer = rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
        writer.parquet(f"{self.path}/{folder}")
        return folder, rows.schema.json()

    def layer(self, table: str, written: tuple[str, str]) -> DataFrame:
        """The rows of a layer that does not count yet."""
        folder, schema = written
        return self._at(table, json.loads(schema), [folder])

    def commit(self, batch: int, written: dict[str, tuple[str, str]], tier: int = 0) -> None:
        """Make layers count, merge what has become too many, and drop what the commit before
        this one replaced (readers may have been at it until now)."""
        number, document = self._commits.read()
        schemas = {**document.get("schemas", {}), **{t: json.loads(s) for t, (_, s) in written.items()}}
        layers = {t: list(document.get("layers", {}).get(t, [])) for t in self.merges}
        for table, (folder, _) in written.items():
            layers[table].append({"folder": folder, "tier": tier})
        document = {**document, "schemas": schemas}
        gone = [f for t in self.merges for f in self._merged(document, t, layers[t], batch)]
        self._commits.write(number, {"batch": batch, "schemas": schemas, "layers": layers, "gone": gone})
        for folder in document.get("gone", []):
            self._commits.remove(f"{self.path}/{folder}")

    def _merged(self, document, table: str, layers: list[dict], batch: int) -> list[str]:
        """Merge full tiers of ``layers`` in place; the folders that are no longer live."""
        gone, tier = [], 0
        while len(full := [x for x in layers if x["tier"] == tier]) >= FAN:
            folders = [x["folder"] for x in full]
            rows = self.merges[table](self._rows(document, table, folders))
            folder, _ = self.write(table, f"b{batch}-tier{tier + 1}", rows)
            layers[:] = [x for x in layers if x not in full] + [{"folder": folder, "tier": tier + 1}]
            gone += folders
            tier += 1
        return gone
