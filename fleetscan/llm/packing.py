"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents are tokenized once and cut into pieces. The pieces' lengths form a histogram whose
size is fixed by the sequence length, so the linear program over packing patterns is solved on
the driver whatever the size of the corpus. Its patterns, rounded to whole numbers, are turned into
ranges of ranks, and pieces, ranked within their length class, are joined to those ranges.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, rows_to_batches, shuffle_partitions, stored

SEQUENCE = 2048
#: Lengths are rounded up to a multiple of this in the linear program.
WIDTH = 8
#: Column generation ends when the bound says that no more than this share can be gained.
GAP = 0.002
END_ID = 1

TOKENIZER = "word_bpe_49k.json"
#: Marks the end of each word for the faster encoder; texts that hold it take the plain way.
MARK = "\x01"
#: Characters for which Java and the tokenizer agree on lower case, letters and white space, and
#: which normalisation leaves alone: ASCII but for the mark, and precomposed Latin letters but
#: for the dotted capital I and the long s.
PLAIN = r"^[\x00\x02-\x7FÀ-ÖØ-öø-įı-ňŊ-ž]*$"
#: How the tokenizer's file splits text into words.
WORDS = r"('s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+)"

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
)
PIECES_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)


# -- tokens


def marked(text: Column) -> tuple[Column, Column]:
    """The text with its words marked, and whether that was possible."""
    plain = text.rlike(PLAIN) & ~F.contains(text, F.lit("<|"))
    words = F.regexp_replace(F.lower(text), WORDS, "$1" + MARK)
    return F.when(plain, words).otherwise(text), plain


class Encoder:
    """Ids of the word tokenizer. Marked texts go through ``tiktoken``, which merges the same
    pairs in the same order several times faster; other texts through ``tokenizers`` itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        alphabet = _byte_alphabet()
        ranks = {}
        for token, number in vocab.items():
            if token.startswith("<|"):
                continue
            body, end = (token[:-4], MARK) if token.endswith("</w>") else (token, "")
            ranks[bytes(alphabet[c] for c in body) + end.encode()] = number
        self.fast = tiktoken.Encoding(
            "words",
            pat_str=rf"[^{MARK}\s]+{MARK}",
            mergeable_ranks=ranks,
            special_tokens={},
        )

    def ids(self, text: str, words_marked: bool) -> np.ndarray:
        if words_marked:
            found = self.fast.encode_ordinary(text)
        else:
            found = self.plain.encode(text, add_special_tokens=False).ids
        return np.array([*found, END_ID], dtype="<u4")


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    sequence: int = SEQUENCE,
    with_ids: bool = False,
) -> DataFrame:
    """Token pieces of every document: whole sequences, and what is left at its end.

    ``docs`` has doc_id and text; other columns are not looked at. A null text counts as empty, and
    an empty text is the end id alone. Rows that repeat are packed as often as they come; a null
    doc_id stays null.
    """
    words, plain = marked(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select("doc_id", words.alias("text"), plain.alias("plain"))

    def cut(batches):
        encoder = Encoder(tokenizer or default_tokenizer())

        def out():
            for batch in batches:
                for doc, text, fast in zip(*(column(batch, n) for n in ("doc_id", "text", "plain"))):
                    ids = encoder.ids(text, fast)
                    for start in range(0, len(ids), sequence):
                        part = ids[start : start + sequence]
                        kept = part.astype(np.int32) if with_ids else None
                        yield 4 * len(part) * with_ids, (
                            doc, start, len(part), zlib.crc32(part.tobytes()), len(ids), kept)

        yield from rows_to_batches(out(), PIECES_ARROW)

    found = rows.mapInArrow(cut, PIECES)
    return found if with_ids else found.drop("ids")


# -- the linear program


@dataclass
class Plan:
    """``count`` sequences that each hold ``copies[b]`` pieces of length class b."""

    copies: dict[int, int]
    count: int


def price(duals: np.ndarray, classes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest value: an unbounded knapsack, by dynamic programming over the
    room that is left."""
    useful = np.flatnonzero(duals > 1e-12)
    sizes, values = classes[useful], duals[useful]
    order = np.argsort(sizes, kind="stable")
    sizes, values, useful = sizes[order], values[order], useful[order]
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := upto[room]:
            gains = best[room - sizes[:k]] + values[:k]
            top = int(gains.argmax())
            if gains[top] > best[room] + 1e-12:
                best[room], last[room] = gains[top], top
    pattern, room = np.zeros(len(duals)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        pattern[useful[last[room]]] += 1
        room -= sizes[last[room]]
    return float(best[capacity]), pattern


def fractional_patterns(
    classes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, by the revised simplex method with columns
    priced as they are needed, from the basis of one class to a pattern."""
    n = len(classes)
    patterns = np.diag((capacity // classes).astype(float))
    inverse = np.diag(1.0 / np.diag(patterns))
    use = inverse @ demand
    while True:
        duals = inverse.sum(axis=0)
        value, column_ = price(duals, classes, capacity)
        if value <= 1 + gap:
            return patterns, np.maximum(use, 0)
        direction = inverse @ column_
        rising = direction > 1e-9
        ratios = np.where(rising, np.maximum(use, 0) / np.where(rising, direction, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        use -= step * direction
        use[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        patterns[:, out] = column_


def whole_plans(histogram: dict[int, int], capacity: int, gap: float = GAP) -> list[Plan]:
    """Patterns in whole numbers that hold exactly the pieces of ``histogram`` (size to count):
    the linear program's, rounded down, and the few pieces that remain packed largest first."""
    plans = [Plan({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    classes = np.array(sorted(c for c in histogram if c < capacity and histogram[c]), dtype=int)
    if not len(classes):
        return plans
    demand = np.array([histogram[c] for c in classes], dtype=float)
    patterns, use = fractional_patterns(classes, demand, capacity, gap)
    left = demand.astype(np.int64)
    for k in np.argsort(-use, kind="stable"):
        column_ = np.rint(patterns[:, k]).astype(np.int64)
        held = np.flatnonzero(column_)
        count = min(int(use[k] + 1e-6), int((left[held] // column_[held]).min()))
        if count > 0:
            left[held] -= count * column_[held]
            plans.append(Plan({int(classes[h]): int(column_[h]) for h in held}, count))
    rest: Counter = Counter()
    while left.any():
        room, taken = capacity, {}
        for h in np.flatnonzero(left)[::-1]:
            if fits := min(int(left[h]), room // int(classes[h])):
                taken[int(classes[h])] = fits
                left[h] -= fits
                room -= fits * int(classes[h])
        rest[tuple(taken.items())] += 1
    return plans + [Plan(dict(k), n) for k, n in rest.items()]


# -- assignment


RANGES = pa.schema(
    [("range_class", pa.int32()), *[(c, pa.int64()) for c in ("low", "high", "copies", "base", "slot")]]
)


def pack(found: DataFrame, sequence: int = SEQUENCE, width: int = WIDTH) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces with (doc_id, start, length).

    Pieces are ranked within their length class in salted parts, so that a class with a third of
    all pieces is not one task; each sequence holds at most ``sequence`` pieces.
    """
    spark = found.sparkSession
    if sequence % width:
        raise ValueError("width must divide the sequence length")
    capacity, salts = sequence // width, shuffle_partitions(spark)
    classed = found.withColumn("class", F.ceil(F.col("length") / width).cast("int")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int")
    )
    histogram = {
        r["class"]: r["n"]  # at most one row for each multiple of width up to the sequence length
        for r in classed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    rows, base, ranks = [], 0, Counter()
    for plan in whole_plans(histogram, capacity):
        slot = 0
        for size, copies in sorted(plan.copies.items(), reverse=True):
            upto = ranks[size] + copies * plan.count
            rows.append((size, ranks[size], upto, copies, base, slot))
            ranks[size] = upto
            slot += copies
        base += plan.count
    # an Arrow table needs no Python workers beside those of the stages, a list of rows does
    ranges = spark.createDataFrame(pa.Table.from_batches(rows_to_batches(((0, r) for r in rows), RANGES), RANGES))
    parts = classed.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select(
        F.col("class").alias("p_class"),
        F.col("salt").alias("p_salt"),
        (F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).alias("before"),
    )
    within = Window.partitionBy("class", "salt").orderBy("length", "doc_id", "start")
    ranked = (
        classed.withColumn("place", F.row_number().over(within) - 1)
        .join(before, (F.col("class") == F.col("p_class")) & (F.col("salt") == F.col("p_salt")))
        .withColumn("rank", F.col("place") + F.col("before"))
    )
    # the ranges are as many as the patterns hold classes, whatever the number of pieces
    placed = ranked.join(
        F.broadcast(ranges),
        (F.col("class") == F.col("range_class"))
        & (F.col("rank") >= F.col("low"))
        & (F.col("rank") < F.col("high")),
    )
    rank, copies = F.col("rank") - F.col("low"), F.col("copies")
    order = Window.partitionBy("sequence_id").orderBy("seat")
    return (
        placed.withColumn("sequence_id", F.col("base") + F.floor(rank / copies))
        .withColumn("seat", F.col("slot") + rank % copies)
        .withColumn("offset", F.sum("length").over(order) - F.col("length"))
        .select(*found.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every token of every document in exactly one sequence; one row per piece."""
    return pack(stored(pieces(docs, tokenizer, with_ids=with_ids), "pieces"))


def sequences(packed: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The token arrays, (sequence_id, ids), from pieces packed with their ids. A sequence is
    padded to ``sequence`` unless its length is a power of two."""
    gathered = packed.groupBy("sequence_id").agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]
            )
        ).alias("ids")
    )
    n = F.size("ids")
    whole = F.bit_count(n) == 1
    padding = F.array_repeat(F.lit(pad_id), F.when(whole, 0).otherwise(sequence - n))
    return gathered.select("sequence_id", F.concat("ids", padding).alias("ids"))


def padding_share(lengths: itertools.chain | list[int], sequence: int = SEQUENCE) -> float:
    """The share of padding in sequences of these lengths."""
    held = [(n, n if n & (n - 1) == 0 else sequence) for n in lengths]
    total = sum(m for _, m in held)
    return 1 - sum(n for n, _ in held) / total if total else 0.0
