import math

import numpy as np
import pytest

from fleetscan.llm import neighbors

SCHEMA = "vec_id long, embedding array<float>, label int, node string, kept int"


def _brute(rows):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(np.array(v, np.float32), float)
        return v / np.linalg.norm(v)

    units = [unit(v) if i is not None else None for i, v in rows]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None
               and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen), key=lambda x: (x is None, x or 0))
        out.append((rows[i][0], len(linked[i]), low, rows[i][0] is not None and rows[i][0] == low))
    return sorted(map(str, out))


def _found(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "n", 1) for i, v in rows], SCHEMA)
    got = neighbors.near_duplicates(df)
    return sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got.collect())


@pytest.mark.parametrize("block", [7, 1024])
def test_groups_chains_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    rng = np.random.default_rng(0)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(100)]
    base = rng.standard_normal(16)
    rows += [(200 + k, (base + rng.normal(0, 0.05, 16)).tolist()) for k in range(40)]
    rows += [(300 + k, rows[3][1]) for k in range(30)]
    rows += [(400, (2 * np.array(rows[5][1])).tolist())]
    turn = [(math.cos(a), math.sin(a), 0.0) for a in np.arange(0, 1.5, 0.2)]  # a chain
    rows += [(500 + k, list(v)) for k, v in enumerate(turn)]
    assert _found(spark, rows) == _brute(rows)


def test_odd_vectors(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]),
        (9, [1e-30, 0.0]), (10, [3e38, 1e37]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]),
    ]
    assert _found(spark, rows) == _brute(rows)
    assert _found(spark, []) == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    n, dim = 20_000, 64
    x = neighbors._unit(rng.standard_normal((n, dim)))
    base = x[:1000]
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.95 * base + math.sqrt(1 - 0.95**2) * side
    pivots = x[rng.choice(n, math.ceil(2 * math.sqrt(n)), replace=False)]
    a, b = (neighbors.describe(v, pivots) for v in (base, near))
    shared = np.array([len(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist())])
    assert (shared >= neighbors.LEAST_SHARED).mean() >= 0.98


@pytest.mark.parametrize("block", [100, 1024])
def test_near_copies_of_one_vector_in_a_third_of_the_rows(spark, monkeypatch, block):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    rng = np.random.default_rng(2)
    units = neighbors._unit(rng.standard_normal((900, 64)))
    units[:300] = math.sqrt(0.955) * units[300] + math.sqrt(0.045) * units[:300]
    rows = [(k, v.tolist()) for k, v in enumerate(units)]
    rows += [(1000 + k, (v + rng.normal(0, 0.01, 64)).tolist()) for k, v in enumerate(units[400:440])]
    assert _found(spark, rows) == _brute(rows)


def test_lists_of_homes_hold_every_link_of_a_vector_at_home():
    rng = np.random.default_rng(3)
    dense = rng.standard_normal((40, 8))
    x = neighbors._unit(np.repeat(dense, 50, axis=0) + rng.normal(0, 0.25, (2000, 8)))
    stay, crowded = neighbors.thinned(x[::20])
    pivots = x[::20][stay]
    home, lists = neighbors.home_lists(x, pivots, crowded)
    a, b = np.nonzero(np.triu(x @ x.T >= neighbors.COSINE, 1))
    some = (home[a] >= 0) | (home[b] >= 0)
    assert len(set(home)) > 10 and some.sum() > 1000
    for i, j in zip(a[some], b[some]):
        both = np.intersect1d(lists[i], lists[j])
        assert np.isin(both, (home[i], home[j])).sum() == 1  # compared, and in one list only


def test_a_length_with_one_sampled_pivot(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "MOST_PIVOTS", 1)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 20))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate((base, base + 0.01)))]
    assert _found(spark, rows) == _brute(rows)
