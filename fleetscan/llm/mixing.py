"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, in shuffled order, form a stream of words that is cut into blocks of
equal length. A source gets as many slots as its target needs, going through its blocks again and
again. Slots of all sources lie on one line, each source on a stretch of it in proportion to its
number of slots; the points of the van der Corput sequence, mapped through these cumulative weights,
give the order in which slots are served, so that any stretch of the schedule has the sources in
nearly their shares.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 4096
SEED = "mix"
#: Slots that one row unfolds into, and that one window orders.
CHUNK_BITS = 16


@dataclass
class Mix:
    """``sources``: number, source, weight, source_size, target, quota, blocks, slots, first_slot.
    ``stream``: a row for each document with its place in its source's stream. ``slots``: the
    schedule, a row for each slot, with the words of the block that it takes."""

    sources: DataFrame
    stream: DataFrame
    slots: DataFrame

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target and taken: the words the mix takes of it."""
        block = BLOCK_WORDS
        held = (
            self.stream.filter("size > 0")
            .withColumn(
                "block",
                F.explode(
                    F.sequence(
                        F.floor(F.col("place") / block),
                        F.floor((F.col("place") + F.col("size") - 1) / block),
                    )
                ),
            )
            .select("number", "place", "size", "block")
        )
        slots = self.slots.select(
            F.col("number").alias("s_number"), F.col("block").alias("s_block"), "low", "high"
        )
        words = F.greatest(
            F.least(F.col("place") + F.col("size"), F.col("high"))
            - F.greatest(F.col("place"), F.col("low")),
            F.lit(0),
        )
        takes = (
            held.join(slots, (F.col("number") == F.col("s_number")) & (F.col("block") == F.col("s_block")))
            .groupBy(F.col("number").alias("t_number"), F.col("place").alias("t_place"))
            .agg(F.sum(words).alias("taken"))
        )
        # a place belongs to one document, but for those without words, which take nothing
        return (
            self.stream.join(
                takes,
                (F.col("number") == F.col("t_number"))
                & (F.col("place") == F.col("t_place"))
                & (F.col("size") > 0),
                "left",
            )
            .withColumn("taken", F.coalesce("taken", F.lit(0)))
            .select("doc_id", "source", "size", "source_size", "target", "taken")
        )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source of ``sized`` (source, size). Sources in code point order, null last,
    have the weights 5, 2, 1, repeating. Targets share out all words by weight; one that would be
    above three times its source's size stops there, and the others share the excess.

    With the caps in the order of cap by weight, the capped sources are a prefix, and the level of
    the others follows from what that prefix leaves: two running sums instead of rounds.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = totals.withColumn("number", (F.row_number().over(order) - 1).cast("int"))
    weighed = numbered.withColumn("weight", F.get(weights, F.col("number") % len(WEIGHTS)))
    cap = F.col("source_size") * MOST_REPEATS
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    everything = Window.partitionBy()
    sums = (
        weighed.withColumn("cap", cap)
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("left", F.col("all_words") - F.sum("cap").over(by_cap) + F.col("cap"))
        .withColumn(
            "weight_left", F.col("all_weight") - F.sum("weight").over(by_cap) + F.col("weight")
        )
        .withColumn(
            "free", F.col("left") * F.col("weight") <= F.col("cap") * F.col("weight_left")
        )
    )
    first = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "number", "left", "weight_left"))).over(everything)
    level = sums.withColumn("first", first)
    free = F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("number")) >= F.struct(
        F.col("first.r").alias("r"), F.col("first.number").alias("number")
    )
    share = F.col("first.left").cast("double") * F.col("weight") / F.col("first.weight_left")
    return level.withColumn(
        "target", F.when(free, share).otherwise(F.col("cap").cast("double"))
    ).select("number", "source", "weight", "source_size", "target")


def mix(docs: DataFrame) -> Mix:
    """The mix of ``docs`` (doc_id, source, text; other columns are not looked at).

    A null text has no words; a null source is a source of its own, the last; rows that repeat are
    documents of their own. Documents without words take nothing. An empty table gives empty ones.
    There is one row for each source on the way to the targets, so their number should stay within
    what one task can sort.
    """
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    size, block = F.col("source_size"), F.lit(BLOCK_WORDS)
    passes, rest = F.expr("quota div source_size"), F.expr("quota % source_size")
    sources = stored(
        source_targets(sized)
        .withColumn("quota", F.floor(F.col("target") + 0.5))
        .withColumn("blocks", F.ceil(size / block))
        .withColumn("passes", F.when(size > 0, passes).otherwise(0))
        .withColumn("rest", F.when(size > 0, rest).otherwise(0))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
        .withColumn(
            "first_slot",
            F.sum("slots").over(Window.orderBy("number")) - F.col("slots"),
        ),
        "sources",
    )
    return Mix(sources, _stream(sized, sources), _slots(sources))


def _stream(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document's place in the shuffled stream of its source. Places are summed up within
    hash ranges first, so no task holds a whole source."""
    known = sources.select("number", F.col("source").alias("s_source"), "source_size", "target")
    mixed = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                  .cast("binary"))
    rows = (
        sized.join(known, F.col("source").eqNullSafe(F.col("s_source")))
        .withColumn("mixed", mixed)
        .withColumn("part", F.substring("mixed", 1, 3))
    )
    sums = rows.groupBy("number", "part").agg(F.sum("size").alias("n"))
    before = sums.select(
        F.col("number").alias("b_number"),
        F.col("part").alias("b_part"),
        (F.sum("n").over(Window.partitionBy("number").orderBy("part")) - F.col("n")).alias("before"),
    )
    within = Window.partitionBy("number", "part").orderBy("mixed", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        rows.withColumn("inner", F.sum("size").over(within) - F.col("size"))
        .join(before, (F.col("number") == F.col("b_number")) & (F.col("part") == F.col("b_part")))
        .select(
            "doc_id",
            "source",
            "size",
            "number",
            "source_size",
            "target",
            (F.col("inner") + F.col("before")).alias("place"),
        )
    )


def _slots(sources: DataFrame) -> DataFrame:
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    bits = max(int(total - 1).bit_length(), 1) if total else 1
    chunk = 1 << CHUNK_BITS
    # the source's stretch of the line, in steps of a point; it has at least as many points as slots
    step = f"* {1 << bits} + {max(total, 1) - 1}) div {max(total, 1)}"
    start = F.expr(f"(cast(first_slot as decimal(38, 0)) {step}")
    stop = F.expr(f"(cast(first_slot + slots as decimal(38, 0)) {step}")
    chunks = (
        sources.filter("slots > 0")
        .withColumn("start", start)
        .withColumn("points", stop - start)
        .withColumn(
            "chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(points - 1) div {chunk}")))
        )
        .repartition(max(1, spark.sparkContext.defaultParallelism), "number", "chunk")
    )
    cell = F.explode(
        F.sequence(
            F.col("chunk") * chunk,
            F.least(F.col("chunk") * chunk + chunk, F.col("points")) - 1,
        )
    )
    # the van der Corput sequence takes point v at the turn whose bits are those of v reversed
    point = F.col("start") + F.col("cell")
    turn = F.conv(F.reverse(F.lpad(F.bin(point), bits, "0")), 2, 10).cast("long")
    slots = (
        chunks.withColumn("cell", cell)
        .withColumn("turn", turn)
        .withColumn("part", F.shiftright("turn", CHUNK_BITS))
    )
    counts = slots.groupBy("number", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        F.col("number").alias("b_number"),
        F.col("part").alias("b_part"),
        (F.sum("n").over(Window.partitionBy("number").orderBy("part")) - F.col("n")).alias("before"),
    )
    within = Window.partitionBy("number", "part").orderBy("turn")
    block, rank = F.lit(BLOCK_WORDS), F.col("rank")
    high = F.least((F.col("block") + 1) * block, F.col("source_size"))
    return (
        slots.withColumn("inner", F.row_number().over(within) - 1)
        .join(before, (F.col("number") == F.col("b_number")) & (F.col("part") == F.col("b_part")))
        .withColumn("rank", F.col("inner") + F.col("before"))
        .filter(F.col("rank") < F.col("slots"))
        .withColumn("pass", F.floor(rank / F.col("blocks")))
        .withColumn("block", rank % F.col("blocks"))
        .select(
            "turn",
            "number",
            "source",
            "rank",
            "pass",
            "block",
            (F.col("block") * block).alias("low"),
            F.when(F.col("pass") < F.col("passes"), high)
            .otherwise(F.least(high, F.col("rest")))
            .alias("high"),
        )
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text, n_chars and any others) as the mix takes them: a
    row for each time it takes the whole text, and one with the first words of the text where it
    ends within a document. Rows of which it takes nothing go."""
    key = ["doc_id", "source", "size"]
    same = Window.partitionBy(*key)
    takes = (
        mix(docs)
        .taken()
        .withColumn("k", F.row_number().over(same.orderBy("taken")))
        .select(*[F.col(c).alias(f"t_{c}") for c in key], F.col("k").alias("t_k"), "taken")
    )
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    numbered = rows.withColumn("k", F.row_number().over(same.orderBy("row.text")))
    match = F.col("k") == F.col("t_k")
    for c in key:
        match = match & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    gap = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
    text, rest = F.col("row.text"), F.expr("taken % size")
    pieces = F.when(text.rlike(r"^[\x20\x09-\x0D]"), rest + 1).otherwise(rest).cast("int")
    cut = F.array_join(F.slice(F.split(text, gap), F.lit(1), pieces), "")
    times = F.expr("taken div size + if(taken % size > 0, 1, 0)").cast("int")
    part = F.col("turn") > F.expr("taken div size")
    out = (
        numbered.join(takes, match)
        .filter("taken > 0")
        .withColumn("turn", F.explode(F.sequence(F.lit(1), times)))
        .withColumn("taken_text", F.when(part, cut).otherwise(text))
    )
    changed = {"text": F.col("taken_text"), "n_chars": F.when(part, F.length("taken_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
