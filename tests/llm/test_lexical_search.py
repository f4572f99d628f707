import math
import re

import numpy as np
import pytest

from fleetscan.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _slow(docs, items):
    """Every item against every document, in Python's integers."""
    own = [(i, _terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, held in own:
            if not held:
                continue
            m, score = 100 - 50 + 50 * len(held) * n_docs // n_terms, 0
            for term in terms & set(held):
                df = sum(term in h for _, h in own)
                w, tf = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))), held.count(term)
                score += w * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(scores)[: search.TOP], 1):
            out.append((item, rank, None if null else i, -score))
    return sorted(map(str, out))


def _frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, rank int, norm double"),
        spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, score int"),
    )


def _got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(str(tuple(r)) for r in df.collect())


def _random(seed, n_docs=150, n_items=12):
    rng = np.random.default_rng(seed)
    words = [f"W{k}" if k % 5 else f"été{k}" for k in range(200)]
    share = 1 / np.arange(1, 201)
    share /= share.sum()
    text = lambda n: " ".join(rng.choice(words, n, p=share))
    docs = [(int(rng.integers(0, 120)), text(rng.integers(0, 60))) for _ in range(n_docs)]
    return docs, [(k, text(rng.integers(1, 15))) for k in range(n_items)]


@pytest.mark.parametrize("top, block, pairs", [(50, 4096, 1_000_000), (5, 7, 1_000_000), (3, 16, 40)])
def test_against_all_scores(spark, monkeypatch, top, block, pairs):
    monkeypatch.setattr(search, "TOP", top)
    monkeypatch.setattr(search, "BLOCK_ROWS", block)
    monkeypatch.setattr(search, "PASS_PAIRS", pairs)
    docs, items = _random(top)
    assert _got(search.ranked(*_frames(spark, docs, items))) == _slow(docs, items)


def test_ties_nulls_and_odd_texts(spark, odd_texts):
    docs = [*odd_texts, *((k, "same words here") for k in range(100, 180)), (150, "same words here"), (None, "same words here")]
    items = [(1, "Same words"), (1, "here"), (2, None), (3, ""), (4, "unheard"), (None, "the FOX"), (5, "日本語の文章とрусский")]
    assert _got(search.ranked(*_frames(spark, docs, items))) == _slow(docs, items)


def test_empty_tables(spark):
    docs, items = _random(1, 5, 2)
    d, i = _frames(spark, docs, items)
    assert _got(search.ranked(d.limit(0), i)) == [] and _got(search.ranked(d, i.limit(0))) == []
    assert _got(search.ranked(*_frames(spark, [(1, None), (2, "--")], items))) == []


def test_pieces_of_a_long_text(monkeypatch):
    text = ("ab " * 40 + "x" * 50 + "--Éa b").encode()
    whole = search.term_counts(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(search, "PIECE_BYTES", size)
        assert search.term_counts(text) == whole


def test_bounds_leave_most_vectors_out():
    """A bucket of short vectors is skipped, and light coordinates fetch nothing."""
    block = search._Block(
        np.arange(3), np.ones(3, bool), np.array([1, 1, 2]), np.array([0, 1, 0, 1]), np.array([5, 5, 4, 3]), np.full(3, 5.0)
    )
    item, weight_of = search._Item(0, [0, 1], [10, 1]), np.zeros(2, np.int64)
    item.floor = 43
    block.search(item, weight_of)
    assert item.docs.tolist() == [0, 2] and item.scores.tolist() == [50, 43]
    item.floor = 60
    block._score = None
    block.search(item, weight_of)
