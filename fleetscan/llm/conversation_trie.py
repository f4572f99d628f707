"""The prefix trie of conversations, from sorted shards of turn ids.

Conversations become rows of 16-byte turn ids, range-partitioned in lexicographic order. A shard
sorts its rows as padded matrices of ids, a block of columns at a time; changes from row to row,
OR-ed along the columns, mark where the nodes of each depth start, and ``reduceat`` sums over them.
Only the nodes on the paths of a shard's first and last row can lie on other shards too: these are
joined by digests of their prefixes, shards by the hundred, until none is open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, column_of, shuffle_partitions, stored

#: A conversation takes its first turns from the first of its hundred.
FAMILY = 100
MOST_SHARED = 5
ID_BYTES = 16
#: Turns in one shard, columns of one matrix, shards whose open nodes one task joins.
SHARD_TURNS = 1_000_000
BLOCK = 16
FAN = 256
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE, OPEN, PIECE = 0, 1, 2
PARTS_ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("size", pa.int64()),
        ("shard", pa.int64()),
        ("on_first", pa.bool_()),
        ("on_last", pa.bool_()),
        ("piece", pa.string()),
    ]
)
PARTS = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, size long, "
    "shard long, on_first boolean, on_last boolean, piece string"
)
COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def _turn_id(role: Column, text: Column) -> Column:
    """A digest of role and text, in hex; the length in front keeps them apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): the turn ids of each conversation one after the other, 16 bytes each,
    and the code points of the turns' texts.

    The first h turns are those of the conversation that opens the hundred (all if it has fewer,
    none if there is none), where h is the CRC of the decimal id, modulo 6; then come the
    conversation's own turns after its first h. A hundred conversations share a partition, so the
    head needs no exchange of its own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(conv.isNotNull()).select(
        conv.alias("conv_id"),
        (conv - conv % FAMILY).alias("family"),
        F.struct("turn", _turn_id(role, text).alias("id"), F.length(text).alias("size")).alias("t"),
    )
    n = shuffle_partitions(conversations.sparkSession)
    own = (
        turns.repartition(n, "family")
        .groupBy("family", "conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("own"))
    )
    heads = own.where("conv_id = family").select(
        F.col("family").alias("h_family"), F.slice("own", 1, MOST_SHARED).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    both = own.join(heads, F.col("family") == F.col("h_family"), "left")
    taken = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h)
    all_turns = F.concat(taken, F.slice("own", h + 1, F.size("own")))
    return both.select("conv_id", all_turns.alias("t")).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("t", lambda t: t["id"]), "")).alias("key"),
        F.transform("t", lambda t: t["size"]).alias("sizes"),
    )


@dataclass
class _Level:
    """The nodes of one depth in a shard, in order. ``row``: a row below each; ``parent``: its
    place on the level above; ``ends``: (node, ids of the conversations that end there)."""

    conv: np.ndarray
    count: np.ndarray
    size: np.ndarray
    parent: np.ndarray
    row: np.ndarray
    ends: list[tuple[int, str]]


def _ends(nodes: np.ndarray, conv: np.ndarray) -> list[tuple[int, str]]:
    """(node, ids joined by commas) from the ending rows of a level, sorted by node and id."""
    if not len(nodes):
        return []
    cuts = np.flatnonzero(nodes[1:] != nodes[:-1]) + 1
    ids = list(map(str, conv.tolist()))
    return [(int(nodes[a]), ",".join(ids[a:b])) for a, b in zip([0, *cuts], [*cuts, len(ids)])]


class _Shard:
    """The trie of a shard's rows. Ids are replaced by their ranks in the shard, from 1; 0 pads, so
    that a conversation stands before those that go on where it ends."""

    def __init__(self, conv: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        self.conv, self.lengths, self.ids, self.sizes = conv, lengths, ids, sizes
        self.start = np.cumsum(lengths) - lengths
        high, low = (ids[:, k].astype(np.uint64) for k in (0, 1))
        order = np.lexsort((low, high))
        new = np.ones(len(order), np.int64)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(new)
        self.levels: list[_Level] = []
        #: Turns of the first and of the last row.
        self.first = self.last = 0
        self._build()

    def _build(self) -> None:
        alive = np.argsort(self.conv, kind="stable")
        turnless = alive[self.lengths[alive] == 0]
        self.levels.append(
            _Level(
                self.conv[alive[:1]], np.array([len(alive)]), np.zeros(1, np.int64), np.full(1, -1), alive[:1],
                _ends(np.zeros(len(turnless), np.int64), self.conv[turnless]),
            )
        )
        alive = alive[self.lengths[alive] > 0]
        group = np.zeros(len(alive), np.int64)
        first_open, last_open = not len(turnless), True
        base = 0
        while len(alive):
            alive, group, first, last = self._block(base, alive, group)
            if first_open:
                self.first, first_open = first
            if last_open:
                self.last, last_open = last
            base += BLOCK

    def _block(self, base: int, alive: np.ndarray, group: np.ndarray):
        """Add the levels of one block of columns; ``group`` is each row's node on the level above.
        Returns the rows that go on, their nodes, and for the first and the last path how long it
        is so far and whether it goes on."""
        lengths = self.lengths[alive]
        width = int(min(BLOCK, lengths.max() - base))
        matrix = np.zeros((len(alive), width), np.int64)
        for j in range(width):
            has = lengths > base + j
            matrix[has, j] = self.rank[self.start[alive[has]] + base + j]
        order = np.lexsort((*(matrix[:, j] for j in reversed(range(width))), group))
        alive, group, lengths, matrix = alive[order], group[order], lengths[order], matrix[order]
        changed = np.ones((len(alive), width + 1), bool)
        changed[1:, 0] = group[1:] != group[:-1]
        changed[1:, 1:] = matrix[1:] != matrix[:-1]
        starts_at = np.logical_or.accumulate(changed, axis=1)
        conv, node = self.conv[alive], group
        for j in range(width):
            starts = np.flatnonzero(starts_at[:, j + 1])
            real = matrix[starts, j] != 0
            rows = alive[starts[real]]
            counts = np.diff(np.r_[starts, len(alive)])
            parent = node[starts[real]]
            node = (np.cumsum(real) - 1)[np.cumsum(starts_at[:, j + 1]) - 1]
            ending = np.flatnonzero(lengths == base + j + 1)
            self.levels.append(
                _Level(
                    np.minimum.reduceat(conv, starts)[real], counts[real],
                    self.sizes[self.start[rows] + base + j], parent, rows, _ends(node[ending], conv[ending]),
                )
            )
        edges = np.flatnonzero(starts_at[:, width])
        stop = base + width
        head = lengths[: edges[1]] if len(edges) > 1 else lengths
        tail = lengths[edges[-1] :]
        goes_on = lengths > stop
        return (
            alive[goes_on],
            node[goes_on],
            (min(int(head.min()), stop), bool(head.min() > stop)),
            (min(int(tail.max()), stop), bool(tail.max() > stop)),
        )

    def path_keys(self, depth: int, place: int) -> list[bytes]:
        """Digests of the prefixes of the node at this place of the level, from the root on."""
        row = int(self.levels[depth].row[place])
        digest = hashlib.blake2b(digest_size=ID_BYTES)
        keys = [digest.digest()]
        at = self.start[row]
        for one in self.ids[at : at + depth]:
            digest.update(one.tobytes())
            keys.append(digest.copy().digest())
        return keys

    def parts(self, shard: int) -> Iterator[pa.RecordBatch]:
        """Whole nodes, open ones with the sums of the whole nodes below them, and the ids that
        end at open ones."""
        paths = {0: self.path_keys(self.first, 0), -1: self.path_keys(self.last, -1)}
        n_children, n_leaves, saved = ([np.zeros(len(x.conv), np.int64) for x in self.levels] for _ in range(3))

        def open_at(depth: int) -> dict[int, tuple[bytes, bool, bool]]:
            """Place to (key, on the first path, on the last path)."""
            found: dict = {}
            for end, stop in ((0, self.first), (-1, self.last)):
                if depth <= stop:
                    place = end % len(self.levels[depth].conv)
                    before = found.get(place, (None, False, False))
                    found[place] = (paths[end][depth], before[1] or end == 0, before[2] or end == -1)
            return found

        for depth in range(len(self.levels) - 1, -1, -1):
            level, opened = self.levels[depth], open_at(depth)
            above = open_at(depth - 1) if depth else {}
            whole = np.ones(len(level.conv), bool)
            whole[list(opened)] = False
            n_leaves[depth] = np.where(whole & (n_children[depth] == 0), 1, n_leaves[depth])
            saved[depth] = saved[depth] + np.where(whole, (level.count - 1) * level.size, 0)
            ends = dict(level.ends)
            at = np.flatnonzero(whole)
            if depth:
                up = level.parent[at]
                np.add.at(n_children[depth - 1], up, 1)
                np.add.at(n_leaves[depth - 1], up, n_leaves[depth][at])
                np.add.at(saved[depth - 1], up, saved[depth][at])
                parent_open = [above.get(p, (None,))[0] for p in up.tolist()]
            if len(at):
                yield _parts(
                    len(at),
                    kind=np.full(len(at), NODE),
                    conv_id=level.conv[at],
                    depth=np.full(len(at), depth),
                    parent_conv_id=pa.array(
                        self.levels[depth - 1].conv[up], mask=np.array([k is not None for k in parent_open])
                    ),
                    n_convs=level.count[at],
                    n_children=n_children[depth][at],
                    n_leaves=n_leaves[depth][at],
                    saved_tokens=saved[depth][at],
                    ends_sha256=[
                        hashlib.sha256(ends[k].encode()).hexdigest() if k in ends else NO_ENDS for k in at.tolist()
                    ],
                    parent_key=parent_open,
                )
            for k, (key, on_first, on_last) in opened.items():
                parent = above[int(level.parent[k])][0] if depth else None
                yield _parts(
                    1, kind=[OPEN], conv_id=[level.conv[k]], depth=[depth], n_convs=[level.count[k]],
                    n_children=[n_children[depth][k]], n_leaves=[n_leaves[depth][k]],
                    saved_tokens=[saved[depth][k]], key=[key], parent_key=[parent], size=[level.size[k]],
                    shard=[shard], on_first=[on_first], on_last=[on_last],
                )
                if k in ends:
                    first_id = int(ends[k].split(",", 1)[0])
                    yield _parts(1, kind=[PIECE], conv_id=[first_id], key=[key], piece=[ends[k]])


def _parts(n: int, **given) -> pa.RecordBatch:
    columns = [
        given[f.name] if isinstance(given.get(f.name), pa.Array)
        else pa.array(given[f.name], f.type) if f.name in given
        else pa.nulls(n, f.type)
        for f in PARTS_ARROW
    ]
    return pa.RecordBatch.from_arrays(columns, schema=PARTS_ARROW)


def _together(parts: Iterator[pa.RecordBatch], most_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Small batches joined to larger ones."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= most_rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _shard_parts(batches) -> Iterator[pa.RecordBatch]:
    """The parts of one partition's rows (conv_id, key, sizes, shard)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    shard = column_of(held[0], "shard")[0].as_py()
    conv, lengths, ids, sizes = [], [], [], []
    for batch in held:
        keys, own = column_of(batch, "key"), column_of(batch, "sizes")
        conv.append(column_of(batch, "conv_id").to_numpy())
        data = b"".join(keys.to_pylist())
        ids.append(np.frombuffer(data, ">u8").reshape(-1, 2))
        sizes.append(own.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        lengths.append(np.diff(own.offsets.to_numpy()).astype(np.int64))
    trie = _Shard(*(np.concatenate(x) for x in (conv, lengths, ids, sizes)))
    yield from _together(trie.parts(shard))


def _joined(table: pa.Table, last: bool) -> pa.Table:
    """Open nodes of consecutive shards: those of one key are one node. It stays open if it is on
    the path of the first or the last row of all, unless there are no other shards; a whole node
    counts into its parent."""
    rows = table.to_pylist()
    low, high = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        r["on_first"] = r["on_first"] and r["shard"] == low
        r["on_last"] = r["on_last"] and r["shard"] == high
        node = nodes.get(r["key"])
        if node is None:
            nodes[r["key"]] = r
            continue
        node["conv_id"] = min(node["conv_id"], r["conv_id"])
        for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            node[name] += r[name]
        node["on_first"] |= r["on_first"]
        node["on_last"] |= r["on_last"]
    for node in sorted(nodes.values(), key=lambda r: -r["depth"]):
        node["shard"] = node.pop("family")
        if not last and (node["on_first"] or node["on_last"]):
            continue
        node["kind"] = NODE
        if not node["n_children"]:
            node["n_leaves"] = 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
        parent = nodes.get(node["parent_key"])
        if parent is not None:
            parent["n_children"] += 1
            parent["n_leaves"] += node["n_leaves"]
            parent["saved_tokens"] += node["saved_tokens"]
    return pa.Table.from_pylist(list(nodes.values()), schema=PARTS_ARROW)


def _joined_some(table: pa.Table) -> pa.Table:
    return _joined(table, False)


def _joined_last(table: pa.Table) -> pa.Table:
    return _joined(table, True)


def _closed(parts: DataFrame, shards: int) -> DataFrame:
    """The nodes that lie on several shards, whole. Each round joins the open nodes of up to
    ``FAN`` neighbouring shards or groups of shards, two paths of each, so no task grows with
    the corpus."""
    opened = parts.where(F.col("kind") == OPEN)
    done = None
    while True:
        last = shards <= FAN
        grouped = opened.withColumn("family", F.expr(f"shard div {FAN}"))
        joined = grouped.groupBy("family").applyInArrow(_joined_last if last else _joined_some, PARTS)
        out = stored(joined, "joined")
        whole = out.where(F.col("kind") == NODE)
        done = whole if done is None else done.union(whole)
        if last:
            return done
        opened, shards = out.where(F.col("kind") == OPEN), -(-shards // FAN)


def _end_digests(parts: DataFrame) -> DataFrame:
    """(d_key, digest) of the ids that end at nodes on several shards. The ids of a node are in
    ascending order from shard to shard; a digest runs through them piece by piece."""
    n = shuffle_partitions(parts.sparkSession)
    pieces = parts.where(F.col("kind") == PIECE).select("key", "conv_id", "piece")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            found = []
            for key, piece in zip(column(batch, "key"), column(batch, "piece")):
                if key != now:
                    if now is not None:
                        found.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            if found:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*found))), names=["d_key", "digest"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["d_key", "digest"])

    return (
        pieces.repartition(n, "key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "d_key binary, digest string")
    )


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, key, sizes; see :func:`rebuilt`): conv_id, the
    smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves and saved_tokens of the
    subtree; ends_sha256, the digest of the ascending ids of members that end at the node.

    A conversation is one row; a shard holds about ``SHARD_TURNS`` turns, and equal conversations
    may lie on many shards. Nothing but the sums of open nodes goes from shard to shard.
    """
    spark = sequences.sparkSession
    rows = stored(sequences, "sequences")
    turns = rows.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("c")).first()
    shards = max(shuffle_partitions(spark), -(-max(turns.n, turns.c) // SHARD_TURNS))
    ordered = rows.repartitionByRange(shards, "key", "conv_id").withColumn(
        "shard", F.spark_partition_id().cast("long")
    )
    parts = stored(ordered.mapInArrow(_shard_parts, PARTS), "trie")
    # more partitions than asked for may be made: the number of groups follows from what there is
    most = parts.where(F.col("kind") == OPEN).agg(F.coalesce(F.max("shard"), F.lit(-1)).alias("m")).first().m
    closed = stored(_closed(parts, most + 1), "closed")
    ids = closed.select(F.col("key").alias("p_key"), F.col("conv_id").alias("p_conv"))
    digests = _end_digests(parts)
    several = (
        closed.join(digests, F.col("key") == F.col("d_key"), "left")
        .join(ids, F.col("parent_key") == F.col("p_key"), "left")
        .withColumns(
            {"parent_conv_id": F.col("p_conv"), "ends_sha256": F.coalesce("digest", F.lit(NO_ENDS))}
        )
    )
    whole = parts.where(F.col("kind") == NODE)
    below = (
        whole.where("parent_key is not null")
        .join(ids, F.col("parent_key") == F.col("p_key"))
        .withColumn("parent_conv_id", F.col("p_conv"))
    )
    inner = whole.where("parent_key is null")
    return inner.select(COLUMNS).union(below.select(COLUMNS)).union(several.select(COLUMNS))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt ``conversations`` (conv_id, turn, role, text; other columns are
    not looked at).

    Turns are ordered by turn, null first, ties by a digest of role and text; a null role or text is
    empty; rows that repeat are turns of their own. Rows without a conv_id belong to no
    conversation and are left out. Turns are told apart by 128-bit digests. An empty table gives
    no nodes, not even a root.
    """
    return prefix_trie(rebuilt(conversations))
