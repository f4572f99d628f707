"""Exact Jaccard join of texts on word shingles, with signature trees.

Texts with equal sets are one class. Two linked sets must share one of their first shingles in any
fixed order (the prefix filter); with common shingles last in that order, few unlinked sets do. The
sets that share a first shingle form a group, and within a group a signature tree decides
which to compare: its nodes hold the OR of their sets' bitmaps and their range of sizes, and
walking two trees at once drops node pairs whose largest possible overlap is too small. What is
left is counted exactly. A group too large for a task is cut into parts, compared two by two.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, column_of, rows_to_batches, shuffle_partitions, stored, summed_arrays
from .components import components, dealt, in_blocks, roots, tasks

SHINGLE = 5
#: Linked: PER_CENT * (size of the union) <= 100 * (size of the intersection).
PER_CENT = 75
#: Counters of shingles, by a part of the hash, whatever the size of the corpus: they give the order
#: from rare to common, which need not be exact.
COUNTERS = 1 << 21
#: Bits by which texts that are in no group are left out before the texts are dealt out.
CANDIDATE_BITS = 1 << 23
BLOCK = 512
LEAF, FAN = 16, 8

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


# -- shingles


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)


#: Powers that a worker keeps; a longer text has its own worked out and dropped.
KEPT_POWERS = 1 << 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE & 0xFFFFFFFFFFFFFFFF, np.uint64)
    inverse = np.full(n, _INVERSE, np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


@lru_cache(1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(KEPT_POWERS)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to n of them."""
    if n > KEPT_POWERS:
        return _powers(n)
    up, down = _kept_powers()
    return up[:n], down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes: words are runs of characters other than
    space and the ASCII controls 9 to 13, with A to Z in lower case. A text of one to four words is
    one shingle; a null text or one without words has none."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    padded = np.concatenate(([False], inside, [False]))
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_byte_values()[data] * up[:-1])))
    words = _mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    n = min(SHINGLE, len(words))
    held = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        held = held * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(held)]
        held ^= held >> np.uint64(32)
    return np.unique(_mixed(held))


def set_digest(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set. Sets are told apart by it and their size: with n different
    sets, two are mixed up with a probability below n * n / 2**65."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of ``levels`` (how common a counter's shingles are)
    and then of hashes: so many that any linked set has one of them among its own first ones."""
    n = len(s)
    keep = n - -(-PER_CENT * n // 100) + 1 if n else 0
    order = np.argsort(levels[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
    return s[order[:keep]]


# -- signature trees


@dataclass
class Tree:
    """Levels from leaves to root. ``bits`` has a bitmap for each node, ``low`` and ``high`` its
    range of set sizes, ``lost`` the most shingles that share a bit with another of their set."""

    bits: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    lost: list[np.ndarray]


def set_bitmaps(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap for each set, and how many of its shingles found their bit taken."""
    out = np.zeros((len(sets), bits), bool)
    for row, s in zip(out, sets):
        row[(s >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
    words = np.packbits(out, axis=1, bitorder="little").view(np.uint64)
    lost = np.array([len(s) for s in sets]) - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    return words, lost


def signature_bits(n: int) -> int:
    """Two to four bits for each shingle, a power of two."""
    return 1 << min(16, max(6, (2 * n - 1).bit_length()))


def signature(s: np.ndarray) -> bytes:
    """The bitmap of one set, as wide as its size asks for."""
    return set_bitmaps([s], signature_bits(len(s)))[0].tobytes() if len(s) else b""


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps of at most twice ``bits`` bits as ones of ``bits`` bits."""
    n = bits // 64
    return words[:, :n] | words[:, n:] if words.shape[1] > n else words


def possible_members(signatures: list[bytes], sizes: np.ndarray, part: np.ndarray | None) -> np.ndarray:
    """Which sets may be linked with another, by dual walks over signatures alone. Linked sets
    have signatures of equal or neighbouring widths, so each width is walked with the next."""
    width = np.array([8 * len(x) for x in signatures])
    out = np.zeros(len(sizes), bool)
    for bits in np.unique(width):
        own = np.flatnonzero((width == bits) | (width == 2 * bits))
        if len(own) < 2:
            continue
        own = own[np.argsort(sizes[own], kind="stable")]
        words = np.concatenate(
            [folded(np.frombuffer(signatures[i], np.uint64)[None, :], int(bits)) for i in own]
        )
        lost = sizes[own] - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        a, b = candidate_pairs(build(words, sizes[own], lost))
        if part is not None:
            across = part[own[a]] != part[own[b]]
            a, b = a[across], b[across]
        out[own[a]] = out[own[b]] = True
    return out


def _merged(x: np.ndarray, fan: int, how) -> np.ndarray:
    return how.reduceat(x, np.arange(0, len(x), fan), axis=0)


def build(words: np.ndarray, sizes: np.ndarray, lost: np.ndarray) -> Tree:
    """A tree over sets in the order given; level 0 has the sets themselves."""
    tree = Tree([words], [sizes], [sizes], [lost])
    while len(tree.bits[-1]) > 1:
        fan = LEAF if len(tree.bits) == 1 else FAN
        tree.bits.append(_merged(tree.bits[-1], fan, np.bitwise_or))
        tree.low.append(_merged(tree.low[-1], fan, np.minimum))
        tree.high.append(_merged(tree.high[-1], fan, np.maximum))
        tree.lost.append(_merged(tree.lost[-1], fan, np.maximum))
    return tree


def _possible(tree: Tree, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether nodes a and b may hold sets that are linked."""
    low, high, lost = tree.low[level], tree.high[level], tree.lost[level]
    near = (100 * high[a] >= PER_CENT * low[b]) & (100 * high[b] >= PER_CENT * low[a])
    a, b = a[near], b[near]
    # |A and B| >= t / (1 + t) * (|A| + |B|), and it is at most the number of common bits
    # and of shingles without a bit of their own
    need = -(-PER_CENT * (low[a] + low[b]) // (100 + PER_CENT))
    at = np.flatnonzero(near)
    good = np.zeros(len(near), bool)
    step = max(1, (1 << 21) // tree.bits[level].shape[1])
    for k in range(0, len(a), step):
        x, y = a[k : k + step], b[k : k + step]
        shared = np.bitwise_count(tree.bits[level][x] & tree.bits[level][y]).sum(axis=1, dtype=np.int64)
        good[at[k : k + step]] = shared + np.minimum(lost[x], lost[y]) >= need[k : k + step]
    return good


def candidate_pairs(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of sets that the dual walk from the root leaves."""
    a = b = np.zeros(1, np.int64)
    for level in range(len(tree.bits) - 1, -1, -1):
        good = _possible(tree, level, a, b)
        a, b = a[good], b[good]
        if level == 0:
            break
        fan, n = (LEAF if level == 1 else FAN), len(tree.bits[level - 1])
        x, y = np.divmod(np.arange(fan * fan), fan)
        a = (a[:, None] * fan + x).ravel()
        b, a_ = (b[:, None] * fan + y).ravel(), a
        inside = (a_ <= b if level > 1 else a_ < b) & (a_ < n) & (b < n)
        a, b = a_[inside], b[inside]
    different = a < b
    return a[different], b[different]


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sets. Many pairs are counted together, by a
    product of matrices over the shingles that occur more than once."""
    if len(a) <= 48:
        return np.array(
            [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64
        )
    used = np.unique(np.concatenate((a, b)))
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    several = times[place] > 1
    owner, col = owner[several], number[place[several]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    total = np.zeros((len(used), len(used)), np.float64)
    width = 4096
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, (start, start + width))
        part = np.zeros((len(used), min(width, int(col[-1]) + 1 - start)), np.float32)
        part[owner[lo:hi], col[lo:hi] - start] = 1
        total += part @ part.T
    rank = np.zeros(len(sets), np.int64)
    rank[used] = np.arange(len(used))
    return total[rank[a], rank[b]].astype(np.int64)


def linked_pairs(sets: list[np.ndarray], across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs a < b among ``sets``; with ``across``, only those between its two sides."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], sizes))
    ordered = [sets[i] for i in order]
    bits = 1 << min(16, max(8, int(4 * sizes.max(initial=1) - 1).bit_length()))
    tree = build(*_signatures(ordered, sizes[order], bits))
    a, b = candidate_pairs(tree)
    if across is not None:
        side = across[order]
        keep = side[a] != side[b]
        a, b = a[keep], b[keep]
    shared = shared_counts(ordered, a, b) if len(a) else np.zeros(0, np.int64)
    union = sizes[order][a] + sizes[order][b] - shared
    good = 100 * shared >= PER_CENT * union
    x, y = order[a[good]], order[b[good]]
    return np.minimum(x, y), np.maximum(x, y)


def _signatures(sets, sizes, bits):
    words, lost = set_bitmaps(sets, bits)
    return words, sizes, lost


# -- the operator

#: Rows of kind 0: a document's set, its size n, digest and signature; of kind 1: counters.
SET = "kind int, doc_id long, text_hash long, n long, node long, key string, data binary"
SET_ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n", pa.int64()),
        ("node", pa.int64()),
        ("key", pa.string()),
        ("data", pa.binary()),
    ]
)
LINK = "node long, root long, links long"
LINK_ARROW = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
CHUNK = 1 << 14


def _sets(texts: DataFrame) -> DataFrame:
    """Of each document its set's size, digest and signature (kind 0), and of each task the
    counters of all its shingles in chunks (kind 1)."""

    def run(batches):
        counters, waiting, held = np.zeros(COUNTERS, np.float32), [], 0

        def count():
            if waiting:
                counters[:] += np.bincount(
                    (np.concatenate(waiting) & np.uint64(COUNTERS - 1)).astype(np.int64),
                    minlength=COUNTERS,
                )
                waiting.clear()

        def rows():
            nonlocal held
            for batch in batches:
                own = (column(batch, c) for c in ("doc_id", "text_hash", "text"))
                for doc, text_hash, text in zip(*own):
                    s = shingles(text)
                    waiting.append(s)
                    held += len(s)
                    if held > 1 << 21:
                        count()
                        held = 0
                    bits = signature(s)
                    yield len(bits), (0, doc, text_hash, len(s), set_digest(s), None, bits)
            count()
            for k in range(0, COUNTERS, CHUNK):
                if counters[k : k + CHUNK].any():
                    yield 4 * CHUNK, (1, None, None, None, None, str(k), counters[k : k + CHUNK].tobytes())

        yield from rows_to_batches(rows(), SET_ARROW)

    return texts.withColumn("text_hash", _text_hash()).mapInArrow(run, SET)


def _text_hash() -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _levels(counters: DataFrame) -> np.ndarray:
    """How common each counter's shingles are, from 0 to 255: sixteen levels for each doubling."""
    total = np.zeros(COUNTERS)
    for r in summed_arrays(counters.select("key", "data"), "float32").collect():
        part = np.frombuffer(r["data"], np.float32)
        total[int(r["key"]) : int(r["key"]) + len(part)] = part
    top = max(np.log2(1 + total.max()), 16.0)
    return np.floor(255 * np.log2(1 + total) / top).astype(np.uint8)


def _first_shingles(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """(node, keys) of each set; a task gives a set it sees again only now and then."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        seen = set()
        for batch in batches:
            nodes, keys = [], []
            for text in column(batch, "text"):
                s = shingles(text)
                if not len(s) or (node := set_digest(s)) in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                keys.append(prefix(s, shared.value).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"]
            )

    return texts.select("text").mapInArrow(run, "node long, keys array<long>")


def _groups(keyed: DataFrame) -> DataFrame:
    """(node, block): sets that share a first shingle, under the smallest of them.

    Rows are range-partitioned by shingle and node, so a shingle of very many sets lies on
    several partitions; only the first and the last shingle of a partition can.
    """
    n = shuffle_partitions(keyed.sparkSession)
    rows = stored(keyed, "keyed").select(F.explode("keys").alias("key"), "node")
    ordered = rows.repartitionByRange(n, "key", "node").sortWithinPartitions("key", "node")
    found = stored(ordered.mapInArrow(_shared_keys, "key long, node long, block long"), "shared")
    opened = found.filter("block is null")
    # two shingles for each partition at most
    ends = (
        opened.groupBy(F.col("key").alias("e_key"))
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .filter("low <> high")
    )
    across = opened.join(F.broadcast(ends), F.col("key") == F.col("e_key")).select("node", F.col("low").alias("block"))
    return found.filter("block is not null").select("node", "block").union(across).distinct()


def _shared_keys(batches):
    """(key, node, block) of one partition's sorted rows: the nodes of each key that has several,
    with the smallest; block is null where the key may go on in another partition."""

    def rows(key, node, block):
        names = ["key", "node", "block"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, node, block)], names)

    now = low = None
    first = several = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (column_of(batch, c).to_numpy() for c in ("key", "node"))
        starts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if now is None:
            now, low, first = key[0], node[0], True
        elif key[0] != now:
            starts = np.r_[0, starts]
        ends = np.r_[starts, len(key)]
        # what goes on from the batch before
        if (stop := int(ends[0])) > 0:
            if first:
                yield rows(key[:stop], node[:stop], [None] * stop)
            elif several or node[stop - 1] != low:
                own = node[:stop] if several else np.r_[low, node[:stop]]
                several = True
                yield rows(np.full(len(own), now), own, np.full(len(own), low))
        if len(starts):
            lengths = np.diff(ends)
            lows, highs = node[starts], node[ends[1:] - 1]
            many = np.repeat(lows != highs, lengths)
            at = int(starts[0])
            if many.any():
                yield rows(key[at:][many], node[at:][many], np.repeat(lows, lengths)[many])
            now, low, first, several = key[-1], lows[-1], False, bool(lows[-1] != highs[-1])
    if now is not None and not first:
        yield rows([now], [low], [None])


def _spread(x: np.ndarray) -> np.ndarray:
    return ((_mixed(x.astype(np.int64).view(np.uint64))) & np.uint64(CANDIDATE_BITS - 1)).astype(np.int64)


def _only_candidates(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(t_id, packed): the compressed texts of rows whose doc_id may be among ``ids``, by a bitmap of
    a fixed size; what it lets through besides falls out in the join that follows."""

    def bits(batches):
        held = np.zeros(CANDIDATE_BITS, bool)
        for batch in batches:
            held[_spread(batch.column(0).to_numpy())] = True
        packed = np.packbits(held)
        for k in range(0, len(packed), CHUNK):
            if packed[k : k + CHUNK].any():
                yield pa.RecordBatch.from_pydict({"key": [str(k)], "data": [packed[k : k + CHUNK].tobytes()]})

    whole = np.zeros(CANDIDATE_BITS // 8, np.uint8)
    parts = ids.mapInArrow(bits, "key string, data binary")
    for r in summed_arrays(parts, "uint8", "or").collect():
        whole[int(r["key"]) : int(r["key"]) + CHUNK] = np.frombuffer(r["data"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(whole)

    def keep(batches):
        held = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            found = batch.filter(pa.array(held[_spread(column_of(batch, "doc_id").to_numpy())]))
            packed = [zlib.compress(t.encode("utf-8"), 1) for t in column(found, "text")]
            yield pa.RecordBatch.from_arrays(
                [column_of(found, "doc_id"), pa.array(packed, pa.binary())], ["t_id", "packed"]
            )

    return texts.filter("doc_id is not null and text is not null").mapInArrow(
        keep, "t_id long, packed binary"
    )


def _able(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``groups`` (node, block) whose set may be linked with another of its block. Only
    signatures are dealt out for it, a small part of the texts."""
    named = classes.select(F.col("node").alias("c_node"), "n", "bits")
    members = in_blocks(groups, "block", "node", BLOCK).join(named, F.col("node") == F.col("c_node"))

    def walk(batches):
        for table in tasks(batches, "block"):
            if table.num_rows < 2:
                continue
            part = None
            if table.column("lo")[0].as_py() != table.column("hi")[0].as_py():
                part = table.column("part").to_numpy()
            sizes = table.column("n").to_numpy()
            good = possible_members(table.column("bits").to_pylist(), sizes, part)
            if good.any():
                found = table.select(["node", "block"]).filter(pa.array(good)).combine_chunks()
                yield from found.to_batches()

    rows = dealt(members.drop("c_node"), "block")
    return rows.mapInArrow(walk, "node long, block long").distinct()


def links(texts: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, root, links): for each group task, each linked set with the first of its
    component there, and how many documents the sets linked to it stand for, each pair counted in
    the smallest of the groups that it shares."""
    blocks = groups.groupBy("node").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    chosen = stored(
        blocks.join(classes.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node")).select(
            "node", "blocks", "first_id", "copies"
        ),
        "candidates",
    )
    # texts are dealt out once to meet their rows, and once to the tasks
    members = in_blocks(chosen.withColumn("block", F.explode("blocks")), "block", "node", BLOCK)
    found = _only_candidates(texts, chosen.select("first_id"))
    placed = members.join(found, F.col("first_id") == F.col("t_id")).drop("first_id", "t_id")

    def verify(batches):
        for table in tasks(batches, "block"):
            block, lo, hi = (table.column(n)[0].as_py() for n in ("block", "lo", "hi"))
            node = table.column("node").to_numpy()
            sets = [shingles(zlib.decompress(t).decode("utf-8")) for t in table.column("packed").to_pylist()]
            same = np.array([set_digest(s) for s in sets]) == node  # else another row of that id
            _, first = np.unique(node[same], return_index=True)
            keep = np.flatnonzero(same)[first]
            if len(keep) < 2:
                continue
            table, node, sets = table.take(pa.array(keep)), node[keep], [sets[i] for i in keep]
            across = table.column("part").to_numpy() if lo != hi else None
            a, b = linked_pairs(sets, across)
            if not len(a):
                continue
            some = np.unique(np.concatenate((a, b)))
            linked = np.zeros((len(some), len(some)), bool)
            x, y = np.searchsorted(some, a), np.searchsorted(some, b)
            linked[x, y] = linked[y, x] = True
            lists = table.column("blocks").take(pa.array(some)).to_pylist()
            earlier = sorted({v for own in lists for v in own if v < block})
            counted = linked
            if earlier:
                held = np.zeros((len(some), len(earlier)), np.float32)
                for row, own in zip(held, lists):
                    row[np.searchsorted(earlier, [v for v in own if v < block])] = 1
                counted = linked & ~(held @ held.T > 0)
            total = counted @ table.column("copies").to_numpy()[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[some]), pa.array(node[some][roots(linked)]), pa.array(total)],
                schema=LINK_ARROW,
            )

    return dealt(placed, "block").mapInArrow(verify, LINK)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of ``docs`` (doc_id, text; other
    columns are not looked at).

    Rows without words, with a null text or a null id link with nothing; a row that links with
    nothing has itself as component. Rows that repeat are linked with each other and each
    counts as a link. Rows of one id with different texts are documents of their own: that they
    have an id in common does not link them. An empty table gives an empty result.
    """
    return _joined(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def _joined(docs: DataFrame) -> DataFrame:
    """The columns of :func:`join`, and for rows with an id and words the text's hash, the set's
    digest (node) and its component's (part)."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    first = stored(_sets(texts), "sets")
    sets = first.filter("kind = 0").select("doc_id", "text_hash", "n", "node", F.col("data").alias("bits"))
    able = sets.filter("n > 0 and doc_id is not null")
    classes = stored(
        able.groupBy("node").agg(
            F.min("doc_id").alias("first_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n").alias("n"),
            F.first("bits").alias("bits"),
        ),
        "classes",
    )
    levels = _levels(first.filter("kind = 1"))
    groups = stored(_groups(_first_shingles(texts.filter("doc_id is not null"), levels)), "groups")
    likely = stored(_able(groups, classes), "likely")
    found = stored(links(texts, classes.drop("n", "bits"), likely), "links")
    counts = found.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    reach = components(edges).withColumnRenamed("node", "g_node")
    joined = classes.drop("n", "bits").join(reach, F.col("node") == F.col("g_node"), "left")
    group_first = (
        joined.filter("component is not null")
        .groupBy(F.col("component").alias("f_component"))
        .agg(F.min("first_id").alias("group_id"))
    )
    placed = (
        joined.join(group_first, F.col("component") == F.col("f_component"), "left")
        .join(counts, F.col("node") == F.col("l_node"), "left")
        .select(
            F.col("node").alias("p_node"),
            F.coalesce("group_id", "first_id").alias("p_id"),
            F.coalesce("component", "node").alias("part"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("p_links"),
        )
    )
    out = able.join(placed, F.col("node") == F.col("p_node")).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("p_id").alias("component_id"),
        F.col("p_links").alias("n_links"),
        "text_hash",
        "node",
        "part",
    )
    rest = sets.filter("not (n > 0 and doc_id is not null)").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("doc_id").alias("component_id"),
        F.lit(0).cast("long").alias("n_links"),
    )
    return out.unionByName(rest, allowMissingColumns=True)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that stay when one document of each
    group of :func:`join` does: that of the smallest doc_id, of several of this id the one whose set
    has the smallest digest, of rows that repeat any one. Rows without id or words all stay."""
    chosen = (
        _joined(docs)
        .filter("part is not null and doc_id = component_id")
        .groupBy("part")
        .agg(F.min(F.struct("node", "text_hash")).alias("one"), F.first("doc_id").alias("k_id"))
        .select("k_id", F.col("one.text_hash").alias("k_hash"))
    )
    linking = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(linking).select("doc_id", _text_hash().alias("text_hash"), F.struct("*").alias("row"))
    firsts = rows.join(
        chosen, (F.col("doc_id") == F.col("k_id")) & (F.col("text_hash") == F.col("k_hash")), "left_semi"
    ).dropDuplicates(["doc_id", "text_hash"])
    return firsts.select("row.*").unionByName(docs.filter(~linking))
