import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscan.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def _linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def _brute(docs):
    sets = [_set(t) for _, t in docs]
    n = len(docs)
    links = [[j for j in range(n) if i != j and docs[i][0] is not None and docs[j][0] is not None and _linked(sets[i], sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((docs[j][0] for j in seen if docs[j][0] is not None), default=None)
        out.append((docs[i][0], len(sets[i]), low, len(links[i])))
    return sorted(map(str, out))


def _found(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.n_links)) for r in jaccard.join(df).collect())


def _variants(seed, n, words, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{rng.integers(1000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            own[at] = f"e{rng.integers(50)}"
        out.append(" ".join(own))
    return out


def test_odd_documents(spark, odd_docs, odd_texts, no_docs):
    assert _found(odd_docs) == _brute(odd_texts)
    assert _found(no_docs) == []


@pytest.mark.parametrize("block", [5, 512])
def test_groups_of_many_sizes(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    passage = " ".join(f"shared{k}" for k in range(60))
    docs = [t for s, (n, w, e) in enumerate([(40, 30, 3), (15, 120, 6), (6, 400, 12), (3, 8, 1), (25, 60, 2)]) for t in _variants(s, n, w, e)]
    docs += [passage + " " + t for t in _variants(9, 30, 50, 25)]  # share a passage, most are not linked
    docs += [docs[0]] * 5 + ["a b c", "A b\tc", "a b c d", "a b"]
    rows = [(k, t) for k, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _found(df) == _brute(rows)


WORDS = st.lists(st.sampled_from("a b c d e f g h".split()), min_size=0, max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, min_size=2, max_size=12), st.integers(0, 2**32))
def test_trees_lose_no_pair(texts, seed):
    texts = [" ".join(t) for t in texts] + [" ".join(texts[0] + ["z"])]
    sets = [s for s in map(jaccard.shingles, texts) if len(s)]
    words = [s for s in map(_set, texts) if s]
    assert [len(s) for s in sets] == [len(s) for s in words]
    if not sets:
        return
    a, b = jaccard.linked_pairs(sets)
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if _linked(words[i], words[j])}
    assert set(zip(a.tolist(), b.tolist())) == want
    bits, sizes = [jaccard.signature(s) for s in sets], np.array([len(s) for s in sets])
    able = jaccard.possible_members(bits, sizes, None)
    assert all(able[i] and able[j] for i, j in want)
    # linked sets share one of their first shingles, whatever shingles are common
    common = np.random.default_rng(seed).integers(0, 4, jaccard.COUNTERS)
    firsts = [set(jaccard.prefix(s, common).tolist()) for s in sets]
    assert all(firsts[i] & firsts[j] for i, j in want)


def test_large_trees_agree_with_counting(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 3)
    monkeypatch.setattr(jaccard, "FAN", 2)
    texts = [t for s in range(12) for t in _variants(s, 20, 40 + 5 * s, 4)]
    sets = [jaccard.shingles(t) for t in texts]
    a, b = jaccard.linked_pairs(sets)
    words = [_set(t) for t in texts]
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if _linked(words[i], words[j])}
    assert set(zip(a.tolist(), b.tolist())) == want
    side = np.arange(len(sets)) % 2
    a, b = jaccard.linked_pairs(sets, side)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in want if side[i] != side[j]}


def test_one_document_of_each_group_stays(spark, odd_docs):
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=lambda x: (x is None, x)) == [1, 2, 3, 4, 5, 6, 10, 12, 13, 14, None]


def test_texts_of_one_id_are_documents_of_their_own(spark):
    a, b, c = ("".join(f"{x}{k} " for k in range(30)) for x in "abc")
    near = b.replace("b29", "other")
    rows = [(1, a), (1, b), (2, b), (3, near), (1, b), (4, c), (4, c + "more"), (5, None), (5, ""), (None, a)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node long")
    assert _found(df) == _brute(rows)
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard.one_of_each(df).collect())
    fours = [t for i, t in kept if i == 4]
    assert len(fours) == 1 and fours[0] in (c, c + "more")
    assert [x for x in kept if x[0] != 4] == [(0, a), (1, a), (1, b), (5, ""), (5, "")]


def test_powers_of_a_long_text_are_not_kept(monkeypatch):
    text = "a b c d e f g " * 50
    whole = jaccard.shingles(text)
    monkeypatch.setattr(jaccard, "KEPT_POWERS", 16)
    jaccard._kept_powers.cache_clear()
    assert (jaccard.shingles(text) == whole).all() and (jaccard.shingles("a b") == jaccard.shingles("A b")).all()
    jaccard._kept_powers.cache_clear()


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_sets_of_one_shingle_on_many_partitions(spark, rows):
    rng = np.random.default_rng(2)
    keyed = [(int(n), [7] * (n % 3 > 0) + [int(k) for k in rng.integers(0, 60, 2)]) for n in range(200)]
    keyed += keyed[:50]  # a set that two tasks saw
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        df = spark.createDataFrame(keyed, "node long, keys array<long>").repartition(6)
        got = {tuple(r) for r in jaccard._groups(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    holders = {}
    for node, keys in keyed:
        for k in keys:
            holders.setdefault(k, set()).add(node)
    assert got == {(n, min(own)) for own in holders.values() if len(own) > 1 for n in own}
