import numpy as np
from pyspark.sql import functions as F

from fleetscan.llm import components


def test_chains_stars_and_none(spark):
    rng = np.random.default_rng(0)
    order = rng.permutation(300).tolist()
    edges = list(zip(order, order[1:])) + [(1000, 1000 + k) for k in range(1, 50)] + [(2000, 2000), (2001, 2002)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {k: 0 for k in range(300)} | {1000 + k: 1000 for k in range(50)} | {2001: 2001, 2002: 2001}
    assert components.components(df.limit(0)).count() == 0


def test_blocks_bring_each_two_members_together_once(spark):
    rows = spark.range(100).select((F.col("id") % 7 * F.col("id") % 3).alias("g"), F.col("id").alias("node"))
    cut = components.in_blocks(rows, "g", "node", 4).collect()
    seen = {}
    for r in cut:
        seen.setdefault((r.g, r.lo, r.hi), []).append((r.node, r.part))
    pairs = [
        (g, *sorted((a, b)))
        for (g, lo, hi), own in seen.items()
        for a, p in own
        for b, q in own
        if a < b and (lo == hi or p != q)
    ]
    by_group = {}
    for r in rows.collect():
        by_group.setdefault(r.g, []).append(r.node)
    want = {(g, a, b) for g, own in by_group.items() for a in own for b in own if a < b}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
