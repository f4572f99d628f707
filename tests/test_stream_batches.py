from pyspark.sql import DataFrame

from tests.test_streaming import SCHEMA, later, results, full_scan, save, seeded  # noqa: F401


def test_a_batch_is_read_once_and_not_kept_in_memory(spark, make_files, seeded, monkeypatch):  # noqa: F811
    state, files = seeded
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = [save("a.ts", "console.log(1)", 0), save("b.ts", "any", 5), save("a.ts", "clean", 9)]
    saved = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("ts", "saved_at").mapInPandas(
        counted, "project_id string, path string, content string, saved_at timestamp"
    )

    def refuse(self, *level):
        raise AssertionError("a batch may be larger than memory")

    monkeypatch.setattr(DataFrame, "persist", refuse)
    monkeypatch.setattr(type(saved), "persist", refuse)
    state.apply(saved, 0)
    assert read.value == 3
    assert results(state) == full_scan(make_files, later(files, p_a="clean", p_b="any"))
