import base64
import hashlib

from fleetscan.llm import warc

SCHEMA = "page_id long, url string, html string, data string"


def _read(spark, rows, chunk_bytes=7, min_bytes=0):
    pages = spark.createDataFrame(rows, SCHEMA)
    manifest = warc.write_archives(warc.chunk_table(pages, min_bytes, chunk_bytes))
    return manifest, warc.read_archives(manifest, chunk_bytes=5)


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_in_small_chunks(spark):
    texts = ["a\r\n\r\nWARC/1.1", "é" * 100, None, "", "same", "same", "same", "x" * 1000, "long " * 50_000]
    rows = [(k, f"http://h/{k}" if k % 2 else None, t, "extra") for k, t in enumerate(texts)]
    manifest, chunks = _read(spark, rows)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    payloads = {}
    for r in chunks.orderBy("page_id", "chunk_no").collect():
        assert len(r.chunk) <= 5
        payloads[r.page_id] = payloads.get(r.page_id, b"") + r.chunk
        assert r.so_far == len(payloads[r.page_id])
        if r.record_type == "response":  # the digest so far is that of the bytes so far
            assert r.digest_so_far == base64.b32encode(hashlib.sha1(payloads[r.page_id]).digest()).decode()
    pages = {r.page_id: r for r in warc.pages_of(chunks).collect()}
    first = {}
    for k, t in enumerate(texts):
        lead = first.setdefault(t or "", k)
        assert pages[k].payload_digest == _digest(t) and pages[k].intact
        assert pages[k].payload_bytes == len((t or "").encode())
        assert (pages[k].record_type, pages[k].refers_to) == (
            ("response", None) if lead == k else ("revisit", lead)
        )
        assert payloads[k] == ((t or "").encode() if lead == k else b"")


def test_small_payloads_are_not_referred_to(spark):
    _, chunks = _read(spark, [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abc", ""), (4, "u", "abc", "")], min_bytes=3)
    assert {r.page_id: r.refers_to for r in warc.pages_of(chunks).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_null_ids_repeated_rows_and_no_rows(spark):
    _, chunks = _read(spark, [(None, None, "a", ""), (None, None, "b", ""), (5, "u", "b", ""), (5, "u", "b", "")])
    found = sorted(
        ((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to) for r in warc.pages_of(chunks).collect()),
        key=str,
    )
    assert found == sorted(
        [(0, _digest("a"), "response", None), (0, _digest("b"), "revisit", 5)]
        + [(5, _digest("b"), "response", None)] * 2,
        key=str,
    )
    manifest, chunks = _read(spark, [])
    assert manifest.count() == 0 and chunks.count() == 0
