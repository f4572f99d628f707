"""Copies of images, cropped or edited, by local descriptors.

Corners are found at scales over two octaves, some in every part of the image; around each, binary
tests on a patch turned to its own orientation give a descriptor. Tables over parts of the descriptors'
bits bring equal parts together; what is near in Hamming distance votes for a rotation, a scale and
a shift, and images with enough votes for one of them are linked.

Images with equal corners are one. In a table's entry, all images meet the first; those that this
has not linked yet then meet each other, so what an entry costs beyond its size are pairs of images
that are not known to be copies. Of these pairs, only those whose images have near corners at as
many spots as a link needs votes go on.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, small_batches, stored
from .components import components, dealt, in_blocks, tasks

#: Linear scales at which corners are sought.
SCALES = (1.0, 4 / 3, 2.0, 8 / 3, 4.0)
#: Of every cell of so many pixels at a scale, the strongest corners are kept.
CELL_PIXELS = 24
CELL_CORNERS = 8
#: Corners this near to the edge are left out, as their patches would be.
MARGIN = 16
LEAST_RESPONSE = 1e3
BITS = 128
#: A descriptor's bits are cut into PARTS; each two of them together are a table's key.
PARTS = 4
TABLES = list(combinations(range(PARTS), 2))
MOST_DIFFERENT = 20
TURNS = 24
SHIFT = 5
SPOT = 6
#: Votes that link two images: so many, and one for so many corners of the one that has fewer.
LEAST_VOTES = 6
CORNERS_PER_VOTE = 5
SEED = 3
#: Pixels handled at once.
HELD_PIXELS = 1 << 20

IMAGES = "image_id long, height int, width int, pixels binary"
IMAGES_ARROW = pa.schema(
    [
        ("image_id", pa.int64()),
        ("height", pa.int32()),
        ("width", pa.int32()),
        ("pixels", pa.binary()),
    ]
)
CORNERS = (
    "image_id long, corner int, x float, y float, scale int, angle float, "
    "d0 long, d1 long, keys array<long>"
)
CORNERS_ARROW = pa.schema(
    [
        ("image_id", pa.int64()),
        ("corner", pa.int32()),
        ("x", pa.float32()),
        ("y", pa.float32()),
        ("scale", pa.int32()),
        ("angle", pa.float32()),
        ("d0", pa.int64()),
        ("d1", pa.int64()),
        ("keys", pa.list_(pa.int64())),
    ]
)


# -- descriptors of a stack of images of one size


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1 pixels, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = x.shape[axis]
        hi, lo = [slice(None)] * 3, [slice(None)] * 3
        hi[axis], lo[axis] = slice(2 * r + 1, 2 * r + 1 + n), slice(0, n)
        x = ((c[tuple(hi)] - c[tuple(lo)]) / (2 * r + 1)).astype(np.float32)
    return x


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear samples at the given reduction."""
    out = x
    for axis in (1, 2):
        n = out.shape[axis]
        at = np.clip((np.arange(int(n / scale)) + 0.5) * scale - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high, part = np.minimum(low + 1, n - 1), (at - low).astype(np.float32)
        shape = [1, 1, 1]
        shape[axis] = len(at)
        part = part.reshape(shape)
        out = np.take(out, low, axis) * (1 - part) + np.take(out, high, axis) * part
    return out


def _corner_response(x: np.ndarray) -> np.ndarray:
    gx, gy = np.zeros_like(x), np.zeros_like(x)
    gx[:, :, 1:-1] = (x[:, :, 2:] - x[:, :, :-2]) / 2
    gy[:, 1:-1, :] = (x[:, 2:, :] - x[:, :-2, :]) / 2
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    return xx * yy - xy * xy - 0.05 * (xx + yy) ** 2


def _peaks(r: np.ndarray) -> np.ndarray:
    """Where a response is the largest of its 5 by 5 neighbourhood."""
    top = r
    for axis in (1, 2):
        best = top
        for d in (1, 2):
            for sign in (1, -1):
                best = np.maximum(best, np.roll(top, sign * d, axis))
        top = best
    return (r == top) & (r > LEAST_RESPONSE)


_RNG = np.random.default_rng(SEED)
_TESTS = _RNG.normal(0, 9, (BITS, 2, 2))
_TESTS *= np.minimum(1, (MARGIN - 1) / np.linalg.norm(_TESTS, axis=2, keepdims=True))
_DISC = np.array([(dy, dx) for dy in range(-8, 9) for dx in range(-8, 9) if dy * dy + dx * dx <= 64])


def _angles(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """From each corner to the intensity centroid of the disc around it."""
    k, y, c = at.T
    values = x[k[:, None], y[:, None] + _DISC[:, 0], c[:, None] + _DISC[:, 1]]
    values = values - values.mean(axis=1, keepdims=True)
    return np.arctan2(values @ _DISC[:, 0].astype(float), values @ _DISC[:, 1].astype(float))


def _bits(x: np.ndarray, at: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """The tests of each corner, turned by its angle, packed into bytes."""
    k, y, c = at.T
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    dy = np.rint(_TESTS[:, :, 0] * cos + _TESTS[:, :, 1] * sin).astype(int)
    dx = np.rint(-_TESTS[:, :, 0] * sin + _TESTS[:, :, 1] * cos).astype(int)
    values = x[k[:, None, None], y[:, None, None] + dy, c[:, None, None] + dx]
    return np.packbits(values[:, :, 0] > values[:, :, 1], axis=1)


def corners(images: np.ndarray) -> list[tuple]:
    """(image, x, y, scale, angle, descriptor bytes) of the strongest corners in each part of a stack
    of images, at each scale, positions in pixels of the image itself. Their number grows with the
    image's area."""
    out = []
    for number, scale in enumerate(SCALES):
        x = _box(_resized(images.astype(np.float32), scale) if scale != 1 else images.astype(np.float32), 1)
        if min(x.shape[1:]) <= 2 * MARGIN:
            continue
        response = _corner_response(x)
        good = _peaks(response)
        good[:, :MARGIN], good[:, -MARGIN:] = False, False
        good[:, :, :MARGIN], good[:, :, -MARGIN:] = False, False
        at = np.argwhere(good)
        if not len(at):
            continue
        strength = response[tuple(at.T)]
        across = -(-x.shape[2] // CELL_PIXELS)
        cell = (at[:, 1] - MARGIN) // CELL_PIXELS * across + (at[:, 2] - MARGIN) // CELL_PIXELS
        order = np.lexsort((at[:, 2], at[:, 1], -strength, cell, at[:, 0]))
        at, cell = at[order], cell[order]
        starts = np.flatnonzero(np.r_[True, (at[1:, 0] != at[:-1, 0]) | (cell[1:] != cell[:-1])])
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        at = at[rank < CELL_CORNERS]
        smooth = _box(x, 1)
        angle = _angles(smooth, at)
        packed = _bits(smooth, at, angle)
        place = (at[:, 1:] + 0.5) * scale - 0.5
        out += [
            (int(k), float(px), float(py), number, float(a), bits.tobytes())
            for (k, _, _), (py, px), a, bits in zip(at, place, angle, packed)
        ]
    return out


def described(images: DataFrame) -> DataFrame:
    """The corners of ``images`` (image_id, height, width and pixels: one byte of grey each). Images
    that are null, empty, too small or of other than height * width bytes have none."""

    def run(batches):
        for batch in batches:
            by_size: dict[tuple, list] = {}
            for row in zip(*(column(batch, n) for n in ("image_id", "height", "width", "pixels"))):
                image, h, w, pixels = row
                if None not in row and h > 0 and w > 0 and len(pixels) == h * w:
                    by_size.setdefault((h, w), []).append((image, pixels))
            for (h, w), held in by_size.items():
                step = max(1, HELD_PIXELS // (h * w))
                for k in range(0, len(held), step):
                    part = held[k : k + step]
                    stack = np.frombuffer(b"".join(p for _, p in part), np.uint8).reshape(-1, h, w)
                    yield _corner_batch([i for i, _ in part], corners(stack))

    return images.select("image_id", "height", "width", "pixels").mapInArrow(run, CORNERS)


def _corner_batch(ids: list[int], found: list[tuple]) -> pa.RecordBatch:
    data = np.frombuffer(b"".join(f[5] for f in found), np.uint8).reshape(len(found), BITS // 8)
    parts = data.view(">u4").astype(np.uint64)
    # keys of different tables may meet by chance: what shares an entry is compared as a whole
    keys = np.stack([_mixed(parts[:, list(chosen)], t) for t, chosen in enumerate(TABLES)], axis=1)
    words = data.view(">i8").astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[f[0]] for f in found], pa.int64()),
            pa.array(np.arange(len(found), dtype=np.int32)),
            pa.array([f[1] for f in found], pa.float32()),
            pa.array([f[2] for f in found], pa.float32()),
            pa.array([f[3] for f in found], pa.int32()),
            pa.array([f[4] for f in found], pa.float32()),
            pa.array(words[:, 0]),
            pa.array(words[:, 1]),
            pa.array(list(keys), pa.list_(pa.int64())),
        ],
        schema=CORNERS_ARROW,
    )


def _mixed(parts: np.ndarray, table: int) -> np.ndarray:
    x = np.full(len(parts), table + 1, np.uint64)
    for part in parts.T:
        x = (x ^ part) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


# -- tables, votes, classes

KNOWN = ["image_id", "corner", "x", "y", "scale", "angle", "d0", "d1"]
#: Corners of an entry that one task compares with each other.
BLOCK = 512


def representatives(found: DataFrame) -> DataFrame:
    """(image_id, same_as): images with corners, each with the smallest id among those whose corners
    are the same, places included."""
    corner = F.xxhash64(*KNOWN[2:])
    sums = found.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(corner).alias("h1"), F.bit_xor(F.xxhash64(corner, F.lit(1))).alias("h2")
    )
    firsts = sums.groupBy("n", "h1", "h2").agg(F.min("image_id").alias("same_as"))
    return sums.join(firsts, ["n", "h1", "h2"]).select("image_id", "same_as")


def _entries(found: DataFrame) -> DataFrame:
    return found.withColumn("key", F.explode("keys")).drop("keys")


def lead_matches(found: DataFrame) -> DataFrame:
    """Pairs of corners (of an image, and of the first image of a table's entry) with descriptors
    that differ in few bits. Every entry gives at most as many rows as it has; the corners of a hot
    image spread over as many entries as it has corners and tables."""
    lead = F.min(F.struct(*KNOWN)).over(Window.partitionBy("key"))
    different = F.bit_count(F.col("d0").bitwiseXOR(F.col("first.d0"))) + F.bit_count(
        F.col("d1").bitwiseXOR(F.col("first.d1"))
    )
    return (
        _entries(found)
        .withColumn("first", lead)
        .filter(F.col("image_id") != F.col("first.image_id"))
        .filter(different <= MOST_DIFFERENT)
        .select(
            *KNOWN[:6],
            F.col("first.image_id").alias("lead"),
            *[F.col(f"first.{c}").alias(f"l_{c}") for c in KNOWN[2:6]],
        )
    )


def _parts(words: np.ndarray) -> np.ndarray:
    """The PARTS of descriptors that are two words each."""
    low = np.uint64(0xFFFFFFFF)
    return np.stack([words[:, 0] >> np.uint64(32), words[:, 0] & low, words[:, 1] >> np.uint64(32), words[:, 1] & low], axis=1)


def _table_of(key: int, words: np.ndarray) -> int:
    """The first table in which this descriptor has that key."""
    parts = _parts(words)
    return next(t for t, chosen in enumerate(TABLES) if _mixed(parts[:, list(chosen)], t)[0] == key)


def _in_earlier_table(differ: np.ndarray, table: int) -> np.ndarray:
    equal = _parts(differ) == 0
    out = np.zeros(len(differ), bool)
    for a, b in TABLES[:table]:
        out |= equal[:, a] & equal[:, b]
    return out


def _all_pairs(n: int, most: int = 1 << 16):
    """All pairs a < b below n, in pieces of bounded size."""
    start = 0
    while start < n - 1:
        stop = min(n - 1, start + max(1, most // n))
        a = np.repeat(np.arange(start, stop), n - 1 - np.arange(start, stop))
        first = np.cumsum(n - 1 - np.arange(start, stop)) - (n - 1 - np.arange(start, stop))
        b = np.arange(len(a)) - np.repeat(first, n - 1 - np.arange(start, stop)) + a + 1
        yield a, b
        start = stop


#: The corners that an image has in entries go along with each of them, if there are at most so many.
#: Pairs with a larger image are not tested before the votes.
MOST_SKETCHED = 256
#: Pairs of corners compared at once by that test.
HELD_PAIRS = 1 << 18


def sketches(members: DataFrame, found: DataFrame) -> DataFrame:
    """s_image, corners (how many it has in ``found``) and the spots and descriptors of its corners in
    entries (s_spot, s_d0, s_d1, by spot; null if too many), for every image of ``members``."""
    spot = [F.round(F.col("x") / SPOT), F.round(F.col("y") / SPOT)]
    numbered = members.select(
        "image_id", "d0", "d1", F.dense_rank().over(Window.partitionBy("image_id").orderBy(*spot)).alias("spot")
    )
    known = numbered.groupBy(F.col("image_id").alias("s_image")).agg(
        F.collect_set(F.when(F.col("spot") <= MOST_SKETCHED, F.struct("spot", "d0", "d1"))).alias("own"),
        F.max("spot").alias("spots"),
    )
    short = (F.size("own") <= MOST_SKETCHED) & (F.col("spots") <= MOST_SKETCHED)
    counts = found.groupBy(F.col("image_id").alias("n_id")).agg(F.count(F.lit(1)).alias("corners"))
    return (
        known.withColumn("own", F.when(short, F.sort_array("own")))
        .join(counts, F.col("s_image") == F.col("n_id"))
        .select("s_image", "corners", *[F.col(f"own.{c}").alias(f"s_{c}") for c in ("spot", "d0", "d1")])
    )


def may_link(table: pa.Table, later: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which pairs of rows have images that may get the votes for a link: votes count spots of the
    later image, and a spot can vote only where one of its corners is near one of the other image and
    shares a table's key with it."""
    _, row, image = np.unique(table.column("image_id").to_numpy(), return_index=True, return_inverse=True)
    rows = table.select(["corners", "s_spot", "s_d0", "s_d1"]).take(pa.array(row)).combine_chunks()
    corners = rows.column("corners").to_numpy()
    lists = rows.column("s_spot").combine_chunks()
    known = lists.is_valid().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    stops = np.cumsum(sizes, dtype=np.int64)
    spots, *words = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("s_spot", "s_d0", "s_d1"))
    pairs, which = np.unique(image[later] * len(row) + image[first], return_inverse=True)
    good = np.ones(len(pairs), bool)
    own, others = np.divmod(pairs, len(row))
    tested = np.flatnonzero(known[own] & known[others])
    work = sizes[own[tested]] * sizes[others[tested]]
    # pairs of one later image, a bounded number of corners at a time
    piece = (np.cumsum(work, dtype=np.int64) - work) // HELD_PAIRS
    edges = np.flatnonzero(np.r_[True, (np.diff(own[tested]) != 0) | (np.diff(piece) != 0)]) if len(tested) else []
    for a, b in zip(edges, [*edges[1:], len(tested)]):
        k, partners = own[tested[a]], others[tested[a:b]]
        mine = slice(stops[k] - sizes[k], stops[k])
        begins = np.cumsum(sizes[partners], dtype=np.int64) - sizes[partners]
        theirs = np.repeat(stops[partners] - sizes[partners] - begins, sizes[partners]) + np.arange(sizes[partners].sum())
        differ, equal = 0, 0
        for w in words:
            x = (w[mine][:, None] ^ w[theirs]).view(np.uint64)
            differ = differ + np.bitwise_count(x)
            equal = equal + (x < 1 << 32).view(np.uint8) + (x.astype(np.uint32) == 0)
        # near, and in a table together: two of the parts are equal
        near = np.logical_or.reduceat((differ <= MOST_DIFFERENT) & (equal >= 2), begins, axis=1)
        starts = np.flatnonzero(np.r_[True, np.diff(spots[mine]) != 0])
        n = np.logical_or.reduceat(near, starts, axis=0).sum(axis=0)
        fewer = np.minimum(corners[k], corners[partners])
        good[tested[a:b]] = (n >= LEAST_VOTES) & (n * CORNERS_PER_VOTE >= fewer)
    return good[which]


MATCH = (
    "image_id long, corner int, x float, y float, scale int, angle float, lead long, "
    "l_x float, l_y float, l_scale int, l_angle float"
)


def other_matches(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of near corners that share an entry and whose images have different ``labels`` (node,
    component; an image without one is its own), as far as a link of the two may follow (see
    :func:`may_link`). Entries of one label are left out first; a large one is cut into blocks that are
    compared two by two."""
    named = labels.select(F.col("node").alias("l_node"), F.col("component").alias("l_component"))
    owner = F.coalesce("l_component", "image_id")
    rows = found.join(named, F.col("image_id") == F.col("l_node"), "left").withColumn("owner", owner)
    rows = _entries(rows.drop("l_node", "l_component"))
    mixed = stored(
        rows.groupBy(F.col("key").alias("m_key"))
        .agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
        .filter("low <> high")
        .select("m_key"),
        "mixed",
    )
    members = rows.join(mixed, F.col("key") == F.col("m_key")).drop("m_key")
    members = stored(members, "members")
    known = stored(sketches(members, found), "sketches")
    members = in_blocks(members, "key", "image_id", BLOCK).join(known, F.col("image_id") == F.col("s_image")).drop("s_image")

    def compare(batches):
        for table in tasks(batches, "key"):
            key, lo, hi = (table.column(c)[0].as_py() for c in ("key", "lo", "hi"))
            owner, part, image = (table.column(c).to_numpy() for c in ("owner", "part", "image_id"))
            words = np.stack([table.column(c).to_numpy() for c in ("d0", "d1")], axis=1).view(np.uint64)
            number = _table_of(key, words[:1])
            pairs = []
            for a, b in _all_pairs(len(owner)):
                other = owner[a] != owner[b]
                if lo != hi:
                    other &= part[a] != part[b]
                a, b = a[other], b[other]
                differ = words[a] ^ words[b]
                near = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= MOST_DIFFERENT
                # two corners that share several tables meet in the first of them
                near &= ~_in_earlier_table(differ, number)
                pairs.append(np.stack([a[near], b[near]]))
            a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
            # the image with the smaller id leads
            later, first = np.where(image[a] > image[b], a, b), np.where(image[a] > image[b], b, a)
            if len(a):
                good = may_link(table, later, first)
                later, first = later[good], first[good]
            if not len(later):
                continue
            own, lead = table.take(pa.array(later)), table.take(pa.array(first))
            columns = [own.column(c) for c in KNOWN[:6]] + [lead.column(c) for c in ("image_id", *KNOWN[2:6])]
            names = [*KNOWN[:6], "lead", *[f"l_{c}" for c in KNOWN[2:6]]]
            yield from pa.table(columns, names=names).combine_chunks().to_batches()

    return dealt(members, "key").mapInArrow(compare, MATCH)


def links(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, lead, votes): images whose matched corners agree on a similarity: turn, scale and,
    on a grid and on the grid shifted by half a step in each direction, shift. Images with many
    corners, of which some agree by chance, need more of them."""
    step = 2 * math.pi / TURNS
    turn = F.pmod(F.round((F.col("l_angle") - F.col("angle")) / step), F.lit(TURNS)).cast("int")
    ratio = F.element_at(F.array(*[F.lit(s) for s in SCALES]), F.col("l_scale") + 1) / F.element_at(
        F.array(*[F.lit(s) for s in SCALES]), F.col("scale") + 1
    )
    cos, sin = F.cos(F.col("turn") * step), F.sin(F.col("turn") * step)
    # a corner that meets the same corner in several tables counts once; most images share a corner
    # or two with some other, and go before the votes are dealt out (no shuffle but this one)
    geometry = [F.col(c) for c in ("x", "y", "scale", "angle", "l_x", "l_y", "l_scale", "l_angle")]
    once = pairs.select("image_id", "lead", "corner", *geometry)
    pair = Window.partitionBy("image_id", "lead")
    enough = F.size(F.collect_set("corner").over(pair)) >= LEAST_VOTES
    moved = (
        once.withColumn("enough", enough)
        .filter("enough")
        .withColumn("turn", turn)
        .withColumn("ratio", ratio)
        .withColumn("tx", F.col("l_x") - F.col("ratio") * (cos * F.col("x") - sin * F.col("y")))
        .withColumn("ty", F.col("l_y") - F.col("ratio") * (sin * F.col("x") + cos * F.col("y")))
        .withColumn("grid", F.explode(F.array(*[F.lit(g) for g in range(4)])))
        .withColumn("bx", F.floor(F.col("tx") / SHIFT + (F.col("grid") % 2) / 2))
        .withColumn("by", F.floor(F.col("ty") / SHIFT + F.floor(F.col("grid") / 2) / 2))
    )
    place = ["image_id", "lead", "turn", "ratio", "grid", "bx", "by"]
    # corners at one spot, found at several scales, are one vote
    spot = F.struct(F.round(F.col("x") / SPOT), F.round(F.col("y") / SPOT))
    votes = moved.groupBy(*place).agg(F.size(F.collect_set(spot)).alias("n"))
    best = (
        votes.filter(F.col("n") >= LEAST_VOTES)
        .groupBy("image_id", "lead")
        .agg(F.max("n").alias("votes"))
    )
    counts = found.groupBy(F.col("image_id").alias("n_id")).agg(F.count(F.lit(1)).alias("corners"))
    lead_counts = counts.select(F.col("n_id").alias("l_id"), F.col("corners").alias("l_corners"))
    fewer = F.least("corners", "l_corners")
    return (
        best.join(counts, F.col("image_id") == F.col("n_id"))
        .join(lead_counts, F.col("lead") == F.col("l_id"))
        .filter(F.col("votes") * CORNERS_PER_VOTE >= fewer)
        .select("image_id", "lead", "votes")
    )


def copies(images: DataFrame) -> DataFrame:
    """image_id, n_corners and class_id (the smallest image_id that links reach) of every row of
    ``images`` (image_id, height, width, pixels; other columns are not looked at).

    Images without corners (null, empty, flat, too small) are classes of their own. A very large
    image has corners in proportion to its area. Rows that
    repeat an id are one image with the corners of all. A null id stays null and is in no class.
    An empty table gives an empty result.
    """
    small_batches(images.sparkSession)
    found = stored(described(images.filter("image_id is not null")), "corners")
    same = stored(representatives(found), "same")
    firsts = same.filter("image_id = same_as").select(F.col("image_id").alias("f_id"))
    chosen = stored(found.join(firsts, F.col("image_id") == F.col("f_id"), "left_semi"), "chosen")
    linked = stored(links(lead_matches(chosen), chosen), "linked")
    edges = linked.select(F.col("image_id").alias("a"), F.col("lead").alias("b"))
    more = stored(links(other_matches(chosen, components(edges)), chosen), "linked")
    edges = edges.union(more.select("image_id", "lead"))
    edges = edges.union(same.filter("image_id <> same_as").select("image_id", "same_as"))
    reach = components(edges)
    counts = found.groupBy(F.col("image_id").alias("n_id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        images.select("image_id")
        .join(counts, F.col("image_id") == F.col("n_id"), "left")
        .join(reach, F.col("image_id") == F.col("node"), "left")
        .select(
            "image_id",
            F.coalesce("n", F.lit(0)).alias("n_corners"),
            F.coalesce("component", "image_id").alias("class_id"),
        )
    )


# -- images drawn from a table


CELL = 10
CELLS = 8


def drawn(vectors: DataFrame) -> DataFrame:
    """Images drawn from ``vectors`` (vec_id, embedding): 8 by 8 cells whose grey values are the
    first 64 components. Image 2 * vec_id is the drawing, of near vectors a near copy; for every
    vec_id divisible by 20, image 2 * vec_id + 1 is a cropped, turned and brightened copy, every fourth
    of these also twice as large. Vectors that are null or hold nulls are images without pixels; rows without vec_id go."""

    def run(batches):
        for batch in batches:
            rows = []
            for vec, v in zip(column(batch, "vec_id"), column(batch, "embedding")):
                if not v or any(c is None or not math.isfinite(c) for c in v):
                    rows.append((2 * vec, None, None, None))
                    continue
                cells = np.zeros(CELLS * CELLS)
                cells[: min(len(v), len(cells))] = v[: len(cells)]
                cells = cells / max(np.abs(cells).max(), 1e-30)
                grey = np.rint(128 + 110 * cells).astype(np.uint8).reshape(CELLS, CELLS)
                picture = np.repeat(np.repeat(grey, CELL, axis=0), CELL, axis=1)
                rows.append((2 * vec, *picture.shape, picture.tobytes()))
                if vec % 20 == 0:
                    cut = picture[5:, : -(CELL // 2)]
                    cut = np.rot90(cut, vec // 20 % 4).astype(float)
                    if vec // 20 % 4 == 1:
                        cut = np.repeat(np.repeat(cut, 2, axis=0), 2, axis=1)
                    edited = np.ascontiguousarray(np.clip(cut * 0.85 + 20, 0, 255).astype(np.uint8))
                    rows.append((2 * vec + 1, *edited.shape, edited.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), IMAGES_ARROW)],
                    schema=IMAGES_ARROW,
                )

    return vectors.filter("vec_id is not null").select("vec_id", "embedding").mapInArrow(run, IMAGES)
