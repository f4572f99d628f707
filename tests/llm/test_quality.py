import numpy as np
from pyspark.sql import functions as F

from fleetscan.llm import quality


def test_rules_as_columns_score_as_in_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    model = quality.fit(x, y, quality.STATISTICS)
    assert 0 < len(model.rules) < 200
    assert np.mean((model.predict(x) >= 0.5) == y) > 0.98
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"q_{k}" for k in quality.STATISTICS])
    got = np.array([r[0] for r in df.select(model.score()).collect()])
    assert np.abs(np.sort(got) - np.sort(model.predict(x))).max() < 1e-9


def test_the_penalty_makes_weights_sparse():
    rng = np.random.default_rng(1)
    h = (rng.random((500, 40)) < 0.5).astype(float)
    y = (h[:, 0] > 0).astype(float)
    _, weights = quality.lasso(h, y, 0.02)
    assert weights[0] > 1 and (np.abs(weights[1:]) < 0.2).all() and (weights == 0).sum() > 20


def test_held_out_documents(spark, data):
    folder = data.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(docs, labels)
    assert got.count() == docs.count()
    held = got.filter("held_out").join(labels, "doc_id").collect()
    good = [r.score for r in held if r.quality == 1]
    bad = [r.score for r in held if r.quality == 0]
    assert np.mean([(np.array(good) > b).mean() for b in bad]) > 0.95
    assert np.mean([r.predicted == 1 for r in held if r.quality == 1]) > 0.97


def test_odd_documents(spark, odd_docs, odd_texts, no_docs):
    some = spark.createDataFrame(
        [(i, q, 0) for i, q in ((4, 1), (5, 0), (6, 1), (6, 1), (9, None), (10, 7), (99, 1), (None, 1))],
        "doc_id long, quality int, toxic int",
    )
    for labels in (some, some.filter("false")):
        rows = quality.scored(odd_docs, labels).collect()
        assert len(rows) == len(odd_texts)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
        assert all(r.held_out for r in rows if r.doc_id is None)
    assert {r.score for r in rows} == {0.5}
    assert quality.scored(no_docs, some).count() == 0
    kept = quality.filtered(odd_docs, some.filter("false"))
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_texts)


def test_statistics_are_finite(spark, odd_docs):
    stats = quality.with_statistics(odd_docs).drop("row")
    assert stats.columns == [f"q_{k}" for k in quality.STATISTICS]
    bad = F.greatest(*[F.coalesce(F.isnan(c) | (F.abs(c) > 1e9), F.lit(True)).cast("int") for c in stats.columns])
    assert stats.filter(bad == 1).count() == 0
