import hashlib

import numpy as np
import pyarrow as pa
import pytest

from fleetscan.llm import line_dedup
from fleetscan.llm.queries import op11_line_dedup


def _key(line):
    key = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def _slow(rows, least_docs=5, least_chars=40):
    """What each row of (doc_id, text) keeps, line by line."""
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(_key(line), set()).add(line_dedup.NO_ID if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = line_dedup.NO_ID if i is None else i
        stay = [
            x for x in lines
            if len(_key(x)) < least_chars or len(holders[_key(x)]) < least_docs or max(holders[_key(x)]) == own
        ]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(map(str, out))


def _frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, pos int, keep string, lines int"
    )


LONG = "A line of more than forty characters, shared by many"
ROWS = [
    *((k, f"own {k}\n \t{LONG}\r\n{LONG.upper()}\nend") for k in range(9)),
    *((k, "é" * 39 + "\n" + "ü" * 40) for k in range(20, 26)),
    *((k, "only four documents hold this line, so it stays") for k in range(30, 34)),
    (40, LONG), (40, LONG), (40, f"other text\n{LONG}"), (40, None),
    (41, ""), (42, "\n\n"), (None, f"{LONG}\nnull id"), (None, None), (3, f"again\n{LONG}"),
    (50, "\n".join([LONG, "x"] * 3000)), (51, "\xa0" + LONG + "\xa0"),
]


@pytest.mark.parametrize("batch_rows, ranges", [(1 << 16, 4_000_000), (3, 5)])
def test_against_line_by_line(spark, monkeypatch, batch_rows, ranges):
    monkeypatch.setattr(line_dedup, "BATCH_ROWS", batch_rows)
    monkeypatch.setattr(line_dedup, "RANGE_ROWS", ranges)
    got = line_dedup.without_repeats(_frame(spark, ROWS)).collect()
    assert sorted(str(tuple(r)) for r in got) == _slow(ROWS)


def test_one_line_in_every_document(spark, monkeypatch):
    """The lines of one hash fill most partitions."""
    monkeypatch.setattr(line_dedup, "RANGE_ROWS", 40)
    rows = [(k, f"{LONG}\nnumber {k} of many lines, no other document has it") for k in range(500)]
    rows += [(k, LONG) for k in range(400, 450)]
    got = line_dedup.without_repeats(_frame(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == _slow(rows)


def test_odd_and_empty_tables(spark, odd_docs, odd_texts, no_docs):
    got = line_dedup.without_repeats(odd_docs).collect()
    assert sorted(str(tuple(r)) for r in got) == _slow(odd_texts)
    assert line_dedup.without_repeats(no_docs).count() == 0
    assert line_dedup.keep_bitmaps(no_docs).columns == ["doc", "text_hash", "n_dropped", "lines", "keep"]


def test_random_texts(spark):
    rng = np.random.default_rng(5)
    pool = [f"{k} " * 25 for k in range(30)] + [f"short {k}" for k in range(9)]
    rows = [(int(rng.integers(0, 60)), "\n".join(rng.choice(pool, rng.integers(0, 9)))) for _ in range(120)]
    got = line_dedup.without_repeats(_frame(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == _slow(rows)


def test_bitmaps():
    for at in ([0], [7], [8], [0, 3, 15, 16], list(range(40))):
        bits = line_dedup.kept(line_dedup.packed(np.array(at)), max(at) + 1)
        assert [k for k, b in enumerate(bits) if not b] == at


def test_digest_is_of_the_kept_text(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    for r in op11_line_dedup(spark, data).collect():
        assert r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_runs_that_go_on_in_the_next_batch(size):
    """One partition's sorted lines in batches of any size: what is dropped, what stays open."""
    rng = np.random.default_rng(size)
    rows = sorted(
        {(int(rng.integers(0, 6)), -int(rng.integers(0, 9)), int(rng.integers(0, 3))) for _ in range(120)}
    )
    table = pa.table(
        [[r[0] for r in rows], [0] * len(rows), [-r[1] for r in rows], [7] * len(rows), pa.array([r[2] for r in rows], pa.int32())],
        schema=line_dedup.LINES_ARROW,
    )
    out = pa.Table.from_batches(line_dedup._decided(table.to_batches(max_chunksize=size), 5), line_dedup.MARKS_ARROW)
    marks = out.to_pylist()
    holders = {}
    for h, d, _ in rows:
        holders.setdefault(h, set()).add(-d)
    first, last = rows[0][0], rows[-1][0]
    want = {(-d, p) for h, d, p in rows if h != first and len(holders[h]) >= 5 and -d < max(holders[h])}
    dropped = [(m["doc"], m["pos"]) for m in marks if m["kind"] == line_dedup.DROPPED]
    assert sorted(dropped) == sorted(
        (-d, p) for h, d, p in rows if h != first and len(holders[h]) >= 5 and -d < max(holders[h])
    ) and set(dropped) == want
    opened = {(m["high"], m["doc"], m["pos"]) for m in marks if m["kind"] == line_dedup.OPEN}
    assert opened == {(h, -d, p) for h, d, p in rows if h == first or (h == last and len(holders[h]) < 5)}
    ends = [(m["high"], m["doc"], m["last_doc"], m["docs"]) for m in marks if m["kind"] == line_dedup.SUMMARY]
    assert ends == [(h, max(holders[h]), min(holders[h]), len(holders[h])) for h in dict.fromkeys([first, last])]
