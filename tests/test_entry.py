import duckdb
import pytest

import __spark_entry__ as entry
from workload.oracle import ORACLES
from workload.queries import QUERIES

DATA = "/root/testdata/sf0.001"
CHECKED = ["score", "all_findings", "repair_steps", "project_context", "apply_fix", "stream_debounce"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["project_id", "score", "deploy_status", "exit_code", "total"]
    assert rows.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(map(str, r)) for r in cursor.fetchall()))
    df = entry.queries()[name](spark, DATA).select(*names)
    assert sorted(tuple(map(str, r)) for r in df.collect()) == want
