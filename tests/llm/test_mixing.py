import re

import pytest

from fleetscan.llm import mixing

WORDS = re.compile(mixing.WORD)


def _targets(sizes):
    """By rounds: share out, cap, share the excess among the rest."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {s: weight[s] * level for s in free} | {s: 3 * sizes[s] for s in capped}
        capped |= set(over)


def _docs(spark, rows):
    return spark.createDataFrame(
        [(i, s, t, len(t or ""), 1, 2) for i, s, t in rows],
        "doc_id long, source string, text string, n_chars long, size int, taken int",
    )


ROWS = [
    *((k, "big", "w " * (10 + k)) for k in range(400)),
    *((1000 + k, "a", "v " * 5) for k in range(4)),
    (2000, None, "n " * 9000),
    (2001, "empty", None),
    (2002, "empty", ""),
    (2003, "", "x"),
    (2003, "", "x"),
    (None, "a", "y\x0bz y"),
]


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_targets_and_takes(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", block)
    sizes = {}
    for _, s, t in ROWS:
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    want = _targets(sizes)
    taken = {}
    rows = mixing.mix(_docs(spark, ROWS)).taken().collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5


def test_the_schedule_serves_every_source_evenly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 8)
    mix = mixing.mix(_docs(spark, ROWS))
    slots = mix.slots.orderBy("turn").collect()
    assert len({r.turn for r in slots}) == len(slots)
    shares = {r.number: r.slots / len(slots) for r in mix.sources.collect()}
    seen = dict.fromkeys(shares, 0)
    for k, r in enumerate(slots, 1):
        assert r.rank == seen[r.number]
        seen[r.number] += 1
        assert all(abs(seen[n] - k * shares[n]) <= 6 for n in shares)


def test_reruns_agree_and_no_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    once, again = (sorted(map(str, mixing.mix(d).taken().collect())) for d in (docs, docs.repartition(7)))
    assert once == again
    assert mixing.mix(docs.limit(0)).taken().count() == 0


def test_rows_as_the_mix_takes_them(spark):
    docs = _docs(spark, ROWS)
    taken = {}
    for r in mixing.mix(docs).taken().collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    got, texts = {}, {t for _, _, t in ROWS}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.source] = got.get(r.source, 0) + len(WORDS.findall(r.text))
        assert r.n_chars == len(r.text)
        assert r.text in texts or any(t and t.startswith(r.text) for t in texts)
    assert got == {s: n for s, n in taken.items() if n}
