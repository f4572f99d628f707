import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetscan.llm import packing

PLAIN = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def _ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def _check(docs, packed):
    """Every id in exactly one piece, offsets without gaps, at most 2048 ids in a sequence."""
    rows = packed.collect()
    want = sorted((i or 0, tuple(_ids(t))) for i, t in docs)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id or 0, r.doc_tokens), []).append(r)
    for doc, ids in want:
        own = by_doc[(doc, len(ids))]
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length
        assert sum(r.length for r in own) % len(ids) == 0
    assert sum(r.length for r in rows) == sum(len(x) for _, x in want)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    return [sum(n for _, n in p) for p in held.values()]


def test_odd_documents(spark, odd_docs, odd_texts):
    packed = packing.pack_documents(odd_docs, with_ids=True)
    _check(odd_texts, packed)
    for r in packed.collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    whole = packing.sequences(packed).collect()
    assert all(len(r.ids) == 2048 or len(r.ids).bit_count() == 1 for r in whole)


def test_given_documents_are_packed_closely(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    packed = packing.pack_documents(docs)
    lengths = _check([(r.doc_id, r.text) for r in docs.collect()], packed)
    assert packing.padding_share(lengths) < 0.03
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in packed.collect()}
    for r in docs.limit(50).collect():
        ids = np.array(_ids(r.text), "<u4")
        for start in range(0, len(ids), 2048):
            assert crc[(r.doc_id, start)] == zlib.crc32(ids[start : start + 2048].tobytes())


def test_no_documents(spark, no_docs):
    assert packing.pack_documents(no_docs).count() == 0


TEXT = st.text(alphabet=st.one_of(st.sampled_from("aAbé'sStTlL rR.,!?12\n\t\x01\x1c\xa0İſßŉ<|>endoftext"), st.characters(codec="utf-8")), max_size=60)


def test_the_fast_encoder_gives_the_tokenizers_ids(spark):
    encoder, found = packing.Encoder(packing.default_tokenizer()), []

    @settings(max_examples=400, deadline=None)
    @given(TEXT)
    def gather(text):
        found.append(text)

    gather()
    found += list(PLAIN.get_vocab())[:5000]
    rows = spark.createDataFrame([(t,) for t in found], "text string")
    marked, plain = packing.marked(rows["text"])
    for r in rows.select("text", marked.alias("m"), plain.alias("p")).collect():
        assert encoder.ids(r.m, r.p).tolist() == _ids(r.text), repr(r.text)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=40))
def test_plans_hold_each_piece_once_and_are_near_the_bound(histogram):
    plans = packing.whole_plans(histogram, 64)
    held = {}
    for p in plans:
        assert sum(c * n for c, n in p.copies.items()) <= 64
        for c, n in p.copies.items():
            held[c] = held.get(c, 0) + n * p.count
    assert held == histogram


def test_column_generation_reaches_the_optimum_of_a_known_case():
    # lengths 3 and 5 in rooms of 8: one of each fills a room
    plans = packing.whole_plans({3: 100, 5: 100}, 8)
    assert sum(p.count for p in plans) == 100
    value, pattern = packing.price(np.array([3.1, 5.0]), np.array([3, 5]), 11)
    assert pattern.tolist() == [2, 1] and abs(value - 11.2) < 1e-9


def test_the_plan_reaches_spark_without_more_python_workers(spark, monkeypatch):
    def parallelize(*_):
        raise AssertionError("rows pass through Python workers of their own")

    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "four " * 3000)], "doc_id long, text string")
    empty = docs.filter("false")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    assert {r.doc_id for r in packing.pack_documents(docs).collect()} == {1, 2, 3}
    assert packing.pack_documents(empty).collect() == []
