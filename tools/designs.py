"""

    python tools/designs.py make TABLE [copies]     derive a table from sf0.1
    python tools/designs.py run TABLE CORES [name ...]
"""

from __future__ import annotations

import os
import statistics
import sys
import time
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from fleetscan import default_registry  # noqa: E402
from fleetscan.functions import paths as P  # noqa: E402
from fleetscan.functions.text import split_lines  # noqa: E402
from fleetscan.operators.context import project_facts, project_summary  # noqa: E402
from fleetscan.operators.observe import observe  # noqa: E402
from fleetscan.operators.selection import mark_selected  # noqa: E402
from fleetscan.rules.model import FileView, LineRule, LineView, ProjectRule, Registry  # noqa: E402
from workload.corpus import all_files  # noqa: E402


def session(cores: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def by_detector(files: DataFrame) -> DataFrame:
    """One branch per detector, all reading the files, and a union."""
    rules = default_registry().rules
    names = dict.fromkeys(r.detector for r in rules)
    parts = [observe(files, Registry([r for r in rules if r.detector == n])) for n in names]
    return reduce(DataFrame.unionByName, parts)


def _line_registry() -> Registry:
    return Registry([r for r in default_registry().rules if isinstance(r, LineRule)])


def exploded_lines(files: DataFrame) -> DataFrame:
    return observe(files, _line_registry(), honour_ignores=False).where("rule_no > 0").select(
        "project_id", "path", "line", "rule_no"
    )


def lambda_lines(files: DataFrame) -> DataFrame:
    """The same line rules inside a lambda over the array of lines."""
    rules = _line_registry().numbered(LineRule)
    path, content = F.col("path"), F.col("content")
    view = FileView(
        path=path, content=content, is_code=P.is_code(path), is_app_code=P.is_app_code(path)
    )
    looked = files.select(
        "project_id", "path", "content",
        *[(F.col("selected") & r.file_when(view)).alias(f"look_{no}") for no, r in rules],
    )
    looked = looked.where(" or ".join(f"look_{no}" for no, _ in rules))
    cut = looked.withColumn("lines", split_lines(content))

    def hits(text, i):
        line = LineView(text, F.get("lines", i + 1))
        return F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(f"look_{no}") & r.line_when(line),
                        F.struct((i + 1).alias("line"), F.lit(no).alias("rule_no")),
                    )
                    for no, r in rules
                ]
            )
        )

    return cut.select("project_id", "path", F.inline(F.flatten(F.transform("lines", hits))))


def scored(files: DataFrame) -> DataFrame:
    registry = default_registry()
    return project_summary(project_facts(observe(files, registry), registry), registry)



DESIGNS = {
    "fused scan to score": scored,
    "fused projection": lambda f: observe(f, default_registry()),
    "one branch per detector": by_detector,
    "line rules, exploded": exploded_lines,
    "line rules, lambda": lambda_lines,
}


def main() -> None:
    mode, table = sys.argv[1:3]
    if mode == "make":
        spark = session("8")
        copies = int(sys.argv[3]) if len(sys.argv) > 3 else 8
        files = all_files(spark, "/root/testdata/sf0.1")
        many = files.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        many.select(
            F.concat_ws("#", "project_id", "copy").alias("project_id"), "path", "content"
        ).repartition(32).write.parquet(table)
        return
    cores, names = sys.argv[3], sys.argv[4:] or list(DESIGNS)
    spark = session(cores)
    raw = spark.read.parquet(table)
    n = raw.count()
    for name in names:
        times = []
        for _ in range(4):
            start = time.perf_counter()
            files = mark_selected(raw)  # ignore rules are part of every scan
            DESIGNS[name](files).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        middle = statistics.median(times[1:])
        print(f"{cores} cores | {name} | {middle:.2f} s | {n / middle:,.0f} files/s", flush=True)


if __name__ == "__main__":
    main()
