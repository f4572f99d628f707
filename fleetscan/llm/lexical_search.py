"""Ranked lexical search by norm buckets of impact vectors.

A document is a vector of term impacts over the terms that items ask for, an item a vector of term
weights; the score is their product. Vectors are ordered by length into buckets. An item looks
into a bucket only if the product of the lengths (Cauchy-Schwarz) can reach its fiftieth score so
far; there, it takes its heaviest coordinates until what the others can add is too little alone,
fetches the vectors that have one of them, and bounds each by what these coordinates give and by the
lengths of what is left. Survivors are scored again, exactly, in integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, column_of, shuffle_partitions, stored

TOP = 50
#: (item, term) pairs that one pass over the documents looks for; more items take more passes.
PASS_PAIRS = 1_000_000
#: Vectors that are bounded together, and their terms; vectors in one bucket of the shuffle.
BLOCK_ROWS = 4096
BLOCK_TERMS = 1 << 20
BUCKET_ROWS = 1_000_000
#: The longest vectors, searched first: their scores prune all other buckets.
FIRST_SHARE = 0.02
#: Bytes of a text that are cut into terms at once.
PIECE_BYTES = 1 << 20
#: What rounding in double precision may take from a bound.
SLACK = 1 + 1e-9

IMPACT = 1_000_000_000
TF_SCALE = 1000
LENGTH_SHARE = 50
LENGTH_SCALE = 20

#: Digits, letters and bytes of characters beyond ASCII belong to terms; others become blanks.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

VECTORS = "doc_id long, length long, terms array<int>, counts array<int>"
VECTORS_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("length", pa.int64()),
        ("terms", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int32())),
    ]
)
HITS = "item int, doc_id long, score long"
HITS_ARROW = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_in(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, A-Z in lower case, a piece at a time."""
    rest = b""
    for at in range(0, len(text), PIECE_BYTES):
        piece = rest + text[at : at + PIECE_BYTES].translate(_TABLE)
        cut = piece.rfind(b" ") + 1 if at + PIECE_BYTES < len(text) else len(piece)
        rest = piece[cut:]
        yield piece[:cut].split()


def term_counts(text: bytes) -> tuple[int, Counter]:
    """The number of terms of a text, and how often each occurs."""
    total, counts = 0, Counter()
    for terms in terms_in(text):
        counts.update(terms)
        total += len(terms)
    return total, counts


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows of one id are one item."""

    def run(batches):
        for batch in batches:
            ids, terms = [], []
            for item, text in zip(column(batch, "item_id"), column(batch, "text")):
                own = term_counts(text)[1]
                ids += [item] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"]
            )

    return (
        items.where(F.col("text").isNotNull())
        .select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
        .mapInArrow(run, "item_id long, term binary")
        .distinct()
    )


def _vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """Each document's length and counts of the vocabulary's terms."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            lengths, sizes, terms, counts = [], [], [], []
            for text in column_of(batch, "text"):
                length, found = term_counts(text.as_py() or b"")
                own = known.keys() & found.keys()
                lengths.append(length)
                sizes.append(len(own))
                terms += [known[t] for t in own]
                counts += [found[t] for t in own]
            offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                ],
                schema=VECTORS_ARROW,
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    ).mapInArrow(run, VECTORS)


def term_weight(n_docs: int, holding: int) -> int:
    """The weight of a term that ``holding`` of ``n_docs`` documents have."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


class _Item:
    """An item's coordinates, the heaviest first, and the length of what is left behind each."""

    def __init__(self, number: int, terms: list[int], weights: list[int]):
        order = np.lexsort((terms, -np.asarray(weights, np.int64)))
        self.number = number
        self.terms = np.asarray(terms, np.int64)[order]
        self.weights = np.asarray(weights, np.int64)[order]
        squares = self.weights.astype(np.float64) ** 2
        self.left = np.sqrt(np.r_[np.cumsum(squares[::-1])[::-1], 0.0])
        self.scores = np.empty(0, np.int64)
        self.docs = np.empty(0, np.int64)
        self.known = np.empty(0, bool)
        self.floor = 0

    def take(self, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        """Keep the best of what there was and these; ``known`` is False for null ids."""
        scores, docs, known = (
            np.concatenate(x) for x in ((self.scores, scores), (self.docs, docs), (self.known, known))
        )
        best = np.lexsort((docs, ~known, -scores))[:TOP]
        self.scores, self.docs, self.known = scores[best], docs[best], known[best]
        if len(best) == TOP:
            self.floor = max(self.floor, int(self.scores[-1]))


class _Block:
    """Some vectors of like length: postings by term, and the vectors themselves."""

    def __init__(self, docs, known, sizes, terms, impacts, norms):
        self.docs, self.known, self.sizes, self.norms = docs, known, sizes, norms
        self.terms, self.impacts = terms, impacts
        self.start = np.cumsum(sizes) - sizes
        self.longest = float(norms.max())
        order = np.argsort(terms, kind="stable")
        self.by_term = terms[order]
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.values = impacts[order].astype(np.float64)

    def search(self, item: _Item, weight_of: np.ndarray) -> None:
        reach = item.left * self.longest * SLACK
        if reach[0] < item.floor or not len(item.terms):
            return
        # as many coordinates as it takes; all of them while there are not enough hits yet
        below = np.flatnonzero(reach < item.floor)
        taken = int(below[0]) if len(below) else len(item.terms)
        heavy = item.terms[:taken]
        lows, highs = (np.searchsorted(self.by_term, heavy, side) for side in ("left", "right"))
        lengths = highs - lows
        total = int(lengths.sum())
        if not total:
            return
        at = np.repeat(lows - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        rows, values = self.rows[at], self.values[at]
        n = len(self.sizes)
        got = np.bincount(rows, values * np.repeat(item.weights[:taken], lengths), n)
        used = np.bincount(rows, values * values, n)
        seen = np.flatnonzero(np.bincount(rows, minlength=n))
        rest = np.sqrt(np.maximum(self.norms[seen] ** 2 * SLACK - used[seen], 0.0)) * item.left[taken]
        self._score(item, seen[(got[seen] + rest) * SLACK >= item.floor], weight_of)

    def _score(self, item: _Item, rows: np.ndarray, weight_of: np.ndarray) -> None:
        if not len(rows):
            return
        sizes = self.sizes[rows]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(self.start[rows] - first, sizes) + np.arange(int(sizes.sum()))
        weight_of[item.terms] = item.weights
        scores = np.add.reduceat(weight_of[self.terms[at]] * self.impacts[at], first)
        weight_of[item.terms] = 0
        good = scores >= max(item.floor, 1)
        if good.any():
            item.take(scores[good], self.docs[rows][good], self.known[rows][good])


def _searched(batches, shared) -> Iterator[pa.RecordBatch]:
    """The best hits of each item in one bucket, its vectors longest first."""
    terms, weights, floors = shared.value
    items = [_Item(k, own, [weights[t] for t in own]) for k, own in enumerate(terms)]
    for item, floor in zip(items, floors):
        item.floor = floor
    weight_of = np.zeros(len(weights), np.int64)
    for block in _blocks(batches):
        for item in items:
            block.search(item, weight_of)
    for item in items:
        if len(item.scores):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(item.scores), item.number, np.int32)),
                    pa.array(item.docs, mask=~item.known),
                    pa.array(item.scores),
                ],
                schema=HITS_ARROW,
            )


def _blocks(batches) -> Iterator[_Block]:
    for batch in batches:
        sizes = np.diff(column_of(batch, "terms").offsets.to_numpy()).astype(np.int64)
        ends = np.cumsum(sizes)
        a = 0
        while a < len(sizes):
            most = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_TERMS, "right"))
            b = min(max(most, a + 1), a + BLOCK_ROWS, len(sizes))
            part = batch.slice(a, b - a)
            ids = column_of(part, "doc_id")
            yield _Block(
                ids.fill_null(0).to_numpy(),
                ids.is_valid().to_numpy(zero_copy_only=False),
                sizes[a:b],
                column_of(part, "terms").flatten().to_numpy().astype(np.int64),
                column_of(part, "impacts").flatten().to_numpy().astype(np.int64),
                column_of(part, "norm").to_numpy(),
            )
            a = b


def _best(hits: DataFrame) -> DataFrame:
    """The best hits of each item, from at most ``TOP`` of each task."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _pass(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The hits of a bounded number of items in all documents."""
    spark = docs.sparkSession
    asked: dict[int | None, list[bytes]] = {}
    for r in pairs.toLocalIterator():
        asked.setdefault(r.item_id, []).append(bytes(r.term))
    ids = sorted(asked, key=lambda i: (i is None, i or 0))
    vocabulary = {t: k for k, t in enumerate(sorted({t for own in asked.values() for t in own}))}
    vectors = stored(_vectors(docs, spark.sparkContext.broadcast(vocabulary)), "vectors")
    sums = vectors.agg(
        F.count_if(F.col("length") > 0).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("terms")
    ).first()
    holding = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = [0] * len(vocabulary)
    for r in holding:
        weights[r.term] = term_weight(sums.docs, r["count"])

    share = F.expr(f"({LENGTH_SHARE} * length * {sums.docs}L) div {max(sums.terms, 1)}L")
    divisor = LENGTH_SCALE * (100 - LENGTH_SHARE + share)
    impact = F.transform(
        "counts", lambda c: F.call_function("div", c.cast("long") * IMPACT, c.cast("long") * TF_SCALE + F.col("divisor"))
    )
    length = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    impacts = (
        vectors.where(F.size("terms") > 0)
        .withColumn("divisor", divisor)
        .withColumn("impacts", impact)
        .select("doc_id", "terms", "impacts", length.alias("norm"))
    )
    held = [[vocabulary[t] for t in asked[i]] for i in ids]
    limit = impacts.agg(F.percentile_approx("norm", 1 - FIRST_SHARE, 1000).alias("at"), F.count(F.lit(1)).alias("n")).first()
    if not limit.n:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    buckets = max(shuffle_partitions(spark), -(-limit.n // BUCKET_ROWS))

    def searched(rows: DataFrame, floors: list[int]) -> DataFrame:
        shared = spark.sparkContext.broadcast((held, weights, floors))
        # copies have equal lengths: their ids spread them
        order = F.desc("norm"), F.col("doc_id")
        ordered = rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order)
        return ordered.mapInArrow(lambda b: _searched(b, shared), HITS)

    first = stored(searched(impacts.where(F.col("norm") >= limit.at), [0] * len(ids)), "hits")
    floors = [0] * len(ids)
    for r in _best(first).where(F.col("rank") == TOP).collect():
        floors[r.item] = r.score
    rest = searched(impacts.where(F.col("norm") < limit.at), floors)
    named = spark.createDataFrame(list(enumerate(ids)), "number int, item_id long")
    return (
        _best(first.union(rest))
        .join(F.broadcast(named), F.col("item") == F.col("number"))
        .select("item_id", "rank", "doc_id", "score")
    )


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``TOP`` best documents of each item with a score above
    0, equal scores by ascending doc_id, null last.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not looked at. Null
    texts have no terms. Every row of ``docs`` is a document of its own; rows of ``items`` with one
    id (null is one) are one item. An item without terms, or whose terms no document has, has no
    rows; empty tables give empty ones.

    The items' terms reach every task, so items are taken in as many passes over the documents as
    it takes to keep ``PASS_PAIRS`` pairs of item and term in each. What a task gives back is at most
    ``TOP`` rows for each item.
    """
    pairs = stored(item_terms(items), "items")
    passes = max(1, -(-pairs.count() // PASS_PAIRS))
    number = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    out = None
    for k in range(passes):
        found = _pass(docs, pairs.where(number == k) if passes > 1 else pairs)
        out = found if out is None else out.union(found)
    return out
