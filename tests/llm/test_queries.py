import duckdb
import pytest

import __spark_entry__ as entry
from fleetscan.llm.queries import ORACLES, QUERIES

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, data, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(map(str, r)) for r in cursor.fetchall())
    df = QUERIES[name](spark, data)
    assert set(df.columns) == set(names)
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == want


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
