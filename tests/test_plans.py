"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from fleetscan import default_registry
from fleetscan.operators.context import project_facts, project_summary
from fleetscan.operators.observe import observe
from fleetscan.operators.selection import mark_selected
from fleetscan.plans.sizing import broadcast_if_small, shared_folder, small, spread


def plan(df, mode="formatted"):
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(modes.fromString(mode))


@pytest.fixture(scope="module")
def corpus(spark, make_files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "files")
    make_files({"p": {"a.ts": "x", ".gitignore": "b"}, "q": {"a.ts": "console.log(1)"}}).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_observing_moves_nothing(corpus, static_plans):
    text = plan(observe(mark_selected(corpus), default_registry()), "simple")
    contents, *rules = text.split("BroadcastExchange")
    assert "Python" not in text and "Exchange" not in contents
    assert contents.count("FileScan") == 1 and [r.count("FileScan") for r in rules] == [1, 1]


def test_generated_code_can_be_compiled(corpus, static_plans):
    """The JVM interprets methods beyond 8000 bytes for good."""
    text = plan(observe(corpus, default_registry()), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_scoring_takes_one_shuffle_for_all_rows_and_one_for_manifests(corpus, static_plans):
    registry = default_registry()
    facts = project_facts(observe(corpus, registry), registry)
    text = plan(project_summary(facts, registry), "simple")
    assert text.count("Exchange hashpartitioning") == 2 and text.count("FileScan") == 1
    assert "Join" not in text and text.count("Generate posexplode") == 1
    assert "Window" not in text and "Cartesian" not in text
    assert "partial_sum" in text


def test_pruned_rules_are_not_in_the_plan(corpus, static_plans):
    text = plan(observe(corpus, default_registry().active(["validation"])), "simple")
    assert "console.log(" not in text and "req.body" in text


def test_ignore_files_are_found_by_pushdown(corpus, static_plans):
    from fleetscan.operators.gitignore import ignore_rules

    assert "EqualTo(path,.gitignore)" in plan(ignore_rules(corpus))


def test_a_million_rules_move_no_contents(spark, make_files, monkeypatch, tmp_path, static_plans):
    from fleetscan.operators import gitignore

    lines = "\n".join(f"rule{k}*.ts" for k in range(1000))
    make_files({f"p{i}": {".gitignore": f"own{i}\n{lines}", "a.ts": "x"} for i in range(20)}).write.parquet(
        str(tmp_path / "files")
    )
    files = spark.read.parquet(str(tmp_path / "files"))
    monkeypatch.setattr(gitignore, "BROADCAST_RULES", 10_000)
    out = gitignore.with_ignored(files, gitignore.ignore_rules(files))
    text = plan(out, "simple")
    assert "Exchange hashpartitioning" not in text and text.count("BroadcastExchange") == 1
    assert out.where("ignored").count() == 0


def test_equal_rule_sets_are_one(spark, make_files):
    from fleetscan.operators import gitignore

    files = make_files({f"p{i}": {".gitignore": "a\n" if i else "b\n"} for i in range(9)})
    sets = gitignore._rule_sets(gitignore.ignore_rules(files)).collect()
    assert len(sets) == 9 and {r.set_id for r in sets} == {"p0", "p1"}


def test_size_checks(spark):
    df = spark.range(10)
    assert small(df, 10) and not small(df, 9)
    assert small(df, 10, weigh=F.col("id")) and not small(df, 10, weigh=F.col("id") * 1_000_000)
    assert "broadcast" in plan(broadcast_if_small(df, 10), "extended").lower()
    assert "broadcast" not in plan(broadcast_if_small(df, 9), "extended").lower()


def test_small_inputs_are_spread(spark, corpus):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(0, 10, 1, 1)
    assert spread(one).rdd.getNumPartitions() == cores
    many = spark.range(0, 10, 1, cores)
    assert spread(many) is many


def test_intermediate_tables_go_to_the_named_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_without_a_named_folder_there_is_none(spark, monkeypatch):
    from fleetscan.plans import sizing

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(spark)
    sizing.use_folder("/somewhere/")
    assert shared_folder(spark) == "/somewhere"
    sizing.use_folder(None)


def test_flags_and_sums_are_hash_aggregated(spark, corpus, static_plans):
    from fleetscan.plans.sizing import stored

    registry = default_registry()
    rows = stored(observe(mark_selected(corpus), registry))
    lines = plan(project_facts(rows, registry), "simple").splitlines()
    assert sum("HashAggregate(" in x and "keys=[project_id" in x and "rule_no" in x for x in lines) >= 1, lines
    # only sums, a row for each project and manifest, are sorted
    assert not any("SortAggregate(" in x and "rule_no" in x for x in lines)
