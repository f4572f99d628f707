"""Lines that many documents share, dropped from all documents but one.

Lines become rows of (hash, document, position), range-partitioned in that order, the largest
document first. A task streams its sorted rows: the first document of a hash keeps its lines, the
others lose theirs as soon as enough documents were seen. A hash of very many lines lies on
several partitions; only the first and the last hash of a partition can, and their rows are decided
from one summary row for each partition. What comes out is a compressed bitmap for each document
that loses lines, never a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, column_of, shuffle_partitions, stored

LEAST_CHARS = 40
LEAST_DOCS = 5
#: The characters stripped at both ends of a line.
BLANK = b" \t\n\x0b\x0c\r"
#: Rows of lines in one range, and in one batch.
RANGE_ROWS = 4_000_000
BATCH_ROWS = 1 << 16
#: What a null id counts as: smaller than any other.
NO_ID = -(1 << 63)

LINES = "high long, low long, doc long, text_hash long, pos int"
LINES_ARROW = pa.schema(
    [("high", pa.int64()), ("low", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32())]
)
DROPPED, OPEN, SUMMARY = 0, 1, 2
MARKS = LINES + ", kind int, last_doc long, docs long"
MARKS_ARROW = pa.schema([*LINES_ARROW, ("kind", pa.int32()), ("last_doc", pa.int64()), ("docs", pa.int64())])


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANK).lower()


def is_long(key: bytes, least: int = LEAST_CHARS) -> bool:
    """Whether a key has at least ``least`` code points."""
    if len(key) < least or key.isascii():
        return len(key) >= least
    heads = np.frombuffer(key, np.uint8) & 0xC0
    return int((heads != 0x80).sum()) >= least


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(_text()).alias("text_hash"),
        _text().cast("binary").alias("text"),
    )


def lines_of(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(high, low, doc, text_hash, pos): the 128-bit hash of the key of every long line."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        hashes, owners, places = [], [], []

        def batch_of():
            parts = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            own = np.array(owners, np.int64).reshape(-1, 3)
            doc, text_hash = (np.repeat(own[:, k], own[:, 2]) for k in (0, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array(a) for a in (parts[:, 0].copy(), parts[:, 1].copy(), doc, text_hash)]
                + [pa.array(places, pa.int32())],
                schema=LINES_ARROW,
            )

        for batch in batches:
            rows = zip(column(batch, "doc"), column(batch, "text_hash"), column_of(batch, "text"))
            for doc, text_hash, text in rows:
                before = len(places)
                for pos, line in enumerate(text.as_py().split(b"\n")):
                    if len(line) >= least_chars:
                        key = line_key(line)
                        if is_long(key, least_chars):
                            hashes.append(digest(key))
                            places.append(pos)
                if len(places) > before:
                    owners.append((doc, text_hash, len(places) - before))
                if len(places) >= BATCH_ROWS:
                    yield batch_of()
                    hashes, owners, places = [], [], []
        if places:
            yield batch_of()

    return _identified(docs).select("doc", "text_hash", "text").mapInArrow(run, LINES)


class _Run:
    """The lines of one hash as they come, largest document first."""

    def __init__(self, high: int, low: int, first: bool):
        self.high, self.low, self.first = high, low, first
        self.top = self.last = None
        self.docs = 0
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def extend(self, rows: tuple[np.ndarray, ...], least_docs: int) -> Iterator[pa.RecordBatch]:
        """Take rows (doc, text_hash, pos) in; give what is decided or open for sure."""
        doc = rows[0]
        if self.top is None:
            self.top = self.last = int(doc[0])
            self.docs = 1
        self.docs += int((doc[1:] != doc[:-1]).sum()) + (int(doc[0]) != self.last)
        self.last = int(doc[-1])
        if self.first:
            yield self.marked(OPEN, rows)
            return
        self.waiting.append(rows)
        if self.docs >= least_docs:
            for held in self.waiting:
                lower = held[0] < self.top
                if lower.any():
                    yield _marks(DROPPED, 0, 0, *(a[lower] for a in held))
            self.waiting = []

    def marked(self, kind: int, rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return _marks(kind, self.high, self.low, *rows)

    def summary(self) -> pa.RecordBatch:
        one = np.array([self.top], np.int64), np.array([0], np.int64), np.array([0], np.int32)
        return _marks(SUMMARY, self.high, self.low, *one, last_doc=self.last, docs=self.docs)


def _marks(kind, high, low, doc, text_hash, pos, last_doc=0, docs=0) -> pa.RecordBatch:
    n = len(doc)
    full = lambda value, dtype=np.int64: np.full(n, value, dtype)
    columns = [full(high), full(low), doc, text_hash, pos, full(kind, np.int32), full(last_doc), full(docs)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=MARKS_ARROW)


def _decided(batches, least_docs: int) -> Iterator[pa.RecordBatch]:
    """Marks of one partition's sorted lines. Runs that end inside a batch are decided together;
    of the one that goes on, no more than the lines of ``least_docs - 1`` documents are held."""
    run = None
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low, doc, text_hash, pos = (
            column_of(batch, f.name).to_numpy(zero_copy_only=False) for f in LINES_ARROW
        )
        starts = np.flatnonzero((high[1:] != high[:-1]) | (low[1:] != low[:-1])) + 1
        if run is None:
            run = _Run(int(high[0]), int(low[0]), True)
        elif (high[0], low[0]) != (run.high, run.low):
            starts = np.r_[0, starts]
        rows = doc, text_hash, pos
        stop = int(starts[0]) if len(starts) else len(doc)
        if stop:
            yield from run.extend(tuple(a[:stop] for a in rows), least_docs)
        if not len(starts):
            continue
        if run.first:
            yield run.summary()
        a, b = int(starts[0]), int(starts[-1])
        if b > a:
            inner = starts[:-1] - a
            own = tuple(x[a:b] for x in rows)
            changed = np.r_[True, own[0][1:] != own[0][:-1]]
            changed[inner] = True
            lengths = np.diff(np.r_[inner, b - a])
            many = np.repeat(np.add.reduceat(changed.astype(np.int64), inner) >= least_docs, lengths)
            drop = many & (own[0] < np.repeat(own[0][inner], lengths))
            if drop.any():
                yield _marks(DROPPED, 0, 0, *(x[drop] for x in own))
        run = _Run(int(high[b]), int(low[b]), False)
        yield from run.extend(tuple(x[b:] for x in rows), least_docs)
    if run is not None:
        for held in run.waiting:
            yield run.marked(OPEN, held)
        yield run.summary()


def packed(positions: np.ndarray) -> bytes:
    """The keep bitmap of a text that loses these lines: a bit for each line up to the last that
    goes, 1 where it stays, deflated."""
    bits = np.ones(int(positions.max()) + 1, np.uint8)
    bits[positions] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def kept(keep: bytes, lines: int) -> np.ndarray:
    """Whether each of the first ``lines`` lines stays, from its bitmap."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return bits[:lines].astype(bool)


def keep_bitmaps(
    docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS
) -> DataFrame:
    """(doc, text_hash, n_dropped, lines, keep): for each text that loses lines, how many, and
    the deflated bitmap of its first ``lines`` lines; the lines after them, and texts without a row,
    stay whole.

    ``docs`` has doc_id and text; other columns are not looked at. Lines end at line feeds; a null
    or empty text is one empty line. Lines are equal if their keys are (see :func:`line_key`);
    keys are told apart by 128-bit hashes. A key of at least ``least_chars`` code points found in
    at least ``least_docs`` documents stays only in the one with the largest id, wherever it stands
    there. Rows of one id are one document in this count, and lose the same keys; a null id is the
    smallest. ``doc`` is the id, or the smallest long for null. Empty tables give empty ones.
    """
    spark = docs.sparkSession
    lines = stored(lines_of(docs, least_chars), "lines")
    ranges = max(shuffle_partitions(spark), -(-lines.count() // RANGE_ROWS))
    order = ["high", "low", F.col("doc").desc(), "text_hash", "pos"]
    ordered = lines.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    marks = stored(ordered.mapInArrow(lambda b: _decided(b, least_docs), MARKS), "marks")
    # two rows at most for each partition: consecutive parts of a hash may share a document
    by_hash = Window.partitionBy("high", "low").orderBy(F.col("doc").desc(), F.col("last_doc").desc())
    shared = F.coalesce((F.lag("last_doc").over(by_hash) == F.col("doc")).cast("long"), F.lit(0))
    heavy = (
        marks.filter(F.col("kind") == SUMMARY)
        .withColumn("own", F.col("docs") - shared)
        .groupBy("high", "low")
        .agg(F.max("doc").alias("top"), F.sum("own").alias("docs"))
        .filter(F.col("docs") >= least_docs)
        .select(F.col("high").alias("h"), F.col("low").alias("l"), "top")
    )
    opened = (
        marks.filter(F.col("kind") == OPEN)
        .join(F.broadcast(heavy), (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")))
        .filter("doc < top")
    )
    place = ["doc", "text_hash", "pos"]
    dropped = marks.filter(F.col("kind") == DROPPED).select(*place).union(opened.select(*place))
    by_text = dropped.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("at"))

    def run(batches):
        for batch in batches:
            sets = [np.asarray(a.values) for a in column_of(batch, "at")]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": column_of(batch, "doc"),
                    "text_hash": column_of(batch, "text_hash"),
                    "n_dropped": pa.array([len(a) for a in sets], pa.int64()),
                    "lines": pa.array([int(a.max()) + 1 for a in sets], pa.int64()),
                    "keep": pa.array([packed(a) for a in sets], pa.binary()),
                }
            )

    return by_text.mapInArrow(run, "doc long, text_hash long, n_dropped long, lines long, keep binary")


TRIMMED = "doc_id long, n_lines long, n_dropped long, text binary"


def trimmed(docs: DataFrame, keeps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for every row of ``docs``: its number of lines, how many
    of them the bitmaps of :func:`keep_bitmaps` drop, and the others joined by line feeds.

    Bitmaps are small and become a broadcast side where Spark measures them so; otherwise texts
    meet them by id and text hash, which splits rows of one id as well.
    """
    keys = keeps.select(F.col("doc").alias("k_doc"), F.col("text_hash").alias("k_hash"), "lines", "keep")
    own = _identified(docs)
    met = own.join(
        keys, (F.col("doc") == F.col("k_doc")) & (F.col("text_hash") == F.col("k_hash")), "left"
    ).select("doc_id", "text", "lines", "keep")

    def run(batches):
        for batch in batches:
            counts, gone, texts = [], [], []
            rows = zip(column_of(batch, "text"), column(batch, "lines"), column(batch, "keep"))
            for text, lines, keep in rows:
                text = text.as_py()
                counts.append(text.count(b"\n") + 1)
                gone.append(0)
                if keep is not None:
                    parts = text.split(b"\n")
                    stays = kept(keep, lines)
                    left = [p for p, s in zip(parts, stays) if s] + parts[lines:]
                    gone[-1] = len(parts) - len(left)
                    text = b"\n".join(left)
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(texts, pa.binary()),
                ],
                names=["doc_id", "n_lines", "n_dropped", "text"],
            )

    return met.mapInArrow(run, TRIMMED).withColumn("text", F.col("text").cast("string"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The texts of ``docs`` without the lines that many share; see :func:`keep_bitmaps`."""
    return trimmed(docs, stored(keep_bitmaps(docs), "keeps"))
