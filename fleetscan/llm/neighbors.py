"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), nearest first. Inverted lists hold
the vectors that have two pivots in common; within a list, pairs that share enough pivots are
verified by their cosine in double precision. Equal vectors are one entry of the index.

Pivots are thinned out, so a dense region has few of them. Where one stands for several sampled
vectors, the region is crowded: the vectors around it are at home there, and every vector that may
link with one of them is in the list of that home. No link with a vector at home is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, stored
from .components import components, dealt, in_blocks, roots, tasks

COSINE = 0.95
#: How many nearest pivots describe a vector, and how many two vectors must share.
NEAREST = 6
LEAST_SHARED = 2
#: Pivots are a sample of at most so many vectors: those with the smallest hashes.
MOST_PIVOTS = 8192
#: No two sampled pivots are nearer than this cosine.
THIN = 0.9
LEAST_PIVOTS = 32
#: Members compared in one task.
BLOCK = 1024
#: Vectors described at once.
ROWS = 1024
SEED = 5

ENTRY = "node long, copies long, dim int, pivots array<int>, home int, unit binary, keys array<long>"
ENTRY_ARROW = pa.schema(
    [
        ("node", pa.int64()),
        ("copies", pa.int64()),
        ("dim", pa.int32()),
        ("pivots", pa.list_(pa.int32())),
        ("home", pa.int32()),
        ("unit", pa.binary()),
        ("keys", pa.list_(pa.int64())),
    ]
)
LINK = "node long, root long, links long"
LINK_ARROW = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def usable(v: Column) -> Column:
    """Not null, of finite components, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def thinned(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows stay when those near an earlier one that stays go, and which of the staying ones
    are crowded: some row went for them."""
    stay, crowded = np.zeros(len(units), bool), np.zeros(len(units), bool)
    for a in range(0, len(units), ROWS):
        part = units[a : a + ROWS]
        earlier = np.flatnonzero(stay)
        near = part @ np.concatenate((units[earlier], part)).T >= THIN
        at = np.concatenate((earlier, np.arange(a, a + len(part))))
        for k in range(len(part)):
            found = at[np.flatnonzero(near[k, : len(earlier) + k])]
            found = found[stay[found]]
            stay[a + k] = not len(found)
            crowded[found[:1]] = True
    return np.flatnonzero(stay), crowded[stay]


def _pivots_of(sample: dict[int, tuple], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The sampled pivots of a dimension and which are crowded; where they are fewer than
    LEAST_PIVOTS, random directions make up the number."""
    pivots, crowded = sample.get(dim, (np.zeros((0, dim)), np.zeros(0, bool)))
    if len(pivots) < LEAST_PIVOTS:
        random = np.random.default_rng(SEED + dim).standard_normal((LEAST_PIVOTS - len(pivots), dim))
        pivots = np.concatenate((pivots, _unit(random)))
        crowded = np.append(crowded, np.zeros(len(random), bool))
        sample[dim] = pivots, crowded
    return pivots, crowded


def describe(units: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The numbers of the nearest pivots of each row, nearest first; ties by number."""
    near = units @ pivots.T
    k = min(nearest, len(pivots))
    top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1).astype(np.int32)


def list_keys(pivots: np.ndarray, dim: int) -> np.ndarray:
    """The inverted lists of each row: one for every two of its pivots."""
    s = np.sort(pivots, axis=1).astype(np.int64)
    a, b = np.triu_indices(s.shape[1], 1)
    return (np.int64(dim) << 40) | (s[:, a] << 20) | s[:, b]


def home_keys(places: np.ndarray, dim: int) -> np.ndarray:
    """The lists of homes: a key that names one pivot twice."""
    s = places.astype(np.int64)
    return (np.int64(dim) << 40) | (s << 20) | s


def home_lists(units: np.ndarray, pivots: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, list]:
    """The home of each row (a crowded pivot, or -1), and the crowded pivots in whose lists it is.

    A row is at home with its nearest crowded pivot unless that is far. If u is at home with p, and
    q is the nearest crowded pivot of v, the way from u to v crosses the plane between p and q; so
    v can link with u only if it is no further from that plane than a link is long. Of two
    homes the smaller number has the pair."""
    places = np.flatnonzero(crowded)
    if not len(places):
        return np.full(len(units), -1, np.int32), [places] * len(units)
    link, slack = math.acos(COSINE), 1e-9
    far = math.acos(THIN) + link
    near = units @ pivots[places].T
    first = near.argmax(axis=1)
    most = near[np.arange(len(units)), first]
    homed = most >= math.cos(far)
    apart = np.sqrt(np.maximum(2 - 2 * pivots[places[first]] @ pivots[places].T, 0))
    inside = most[:, None] - near <= (math.sin(link) + slack) * apart + slack
    inside &= near >= math.cos(far + link) - slack
    inside &= ~homed[:, None] | (np.arange(len(places)) <= first[:, None])
    home = np.where(homed, places[first], -1).astype(np.int32)
    return home, [places[row] for row in inside]


def index(classes: DataFrame) -> DataFrame:
    """The stored index of ``classes`` (node, embedding, copies)."""
    spark = classes.sparkSession
    n = classes.count()
    want = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(2 * math.sqrt(n))))
    rows = classes.orderBy(F.xxhash64("embedding"), "node").limit(want).select("embedding").collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r[0]), []).append(r[0])
    sample = {}
    for dim, held in by_dim.items():
        units = _unit(held)
        stay, crowded = thinned(units)
        sample[dim] = units[stay], crowded
    shared = spark.sparkContext.broadcast(sample)

    def entries(batches):
        sample = dict(shared.value)
        for batch in batches:
            node, copies = column(batch, "node"), column(batch, "copies")
            vectors = column(batch, "embedding")
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                every = np.flatnonzero(dims == dim)
                for own in np.split(every, range(ROWS, len(every), ROWS)):
                    units = _unit([vectors[i] for i in own])
                    known, crowded = _pivots_of(sample, int(dim))
                    pivots = describe(units, known)
                    home, lists = home_lists(units, known, crowded)
                    pairs = list_keys(pivots, int(dim))
                    keys = [
                        np.append(home_keys(places, int(dim)), pair if h < 0 else pair[:0])
                        for h, places, pair in zip(home, lists, pairs)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([node[i] for i in own], pa.int64()),
                            pa.array([copies[i] for i in own], pa.int64()),
                            pa.array(np.full(len(own), dim, np.int32)),
                            pa.array(list(pivots), pa.list_(pa.int32())),
                            pa.array(home),
                            pa.array([u.tobytes() for u in units], pa.binary()),
                            pa.array(keys, pa.list_(pa.int64())),
                        ],
                        schema=ENTRY_ARROW,
                    )

    return stored(classes.select("node", "copies", "embedding").mapInArrow(entries, ENTRY), "index")


def compare(
    pivots: np.ndarray, units: np.ndarray, key: int, cosine: float = COSINE
) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of a list are links, and which of these this list counts: a pair that
    shares more than two pivots is in several lists and counts in the first."""
    p, q = (key >> 20) & 0xFFFFF, key & 0xFFFFF
    linked = units @ units.T >= cosine
    names, place = np.unique(pivots, return_inverse=True)
    held = np.zeros((len(units), len(names)), np.float32)
    held[np.arange(len(units))[:, None], place.reshape(pivots.shape)] = 1
    linked &= held @ held.T >= LEAST_SHARED
    np.fill_diagonal(linked, False)
    earlier = held[:, (names < q) & (names != p)]
    return linked, linked & ~(earlier @ earlier.T > 0)


def compare_at_home(home: np.ndarray, units: np.ndarray, key: int) -> np.ndarray:
    """Which pairs of a home's list are links: those with a vector that is at home there."""
    own = home == (key & 0xFFFFF)
    linked = (units @ units.T >= COSINE) & (own[:, None] | own[None, :])
    np.fill_diagonal(linked, False)
    return linked


def links(entries: DataFrame) -> DataFrame:
    """(node, root, links) from the index: for each list, each linked member with the first
    member of its component there, and the vectors linked to it that count there."""
    members = entries.withColumn("key", F.explode("keys")).select(
        "key", "node", "copies", "pivots", "home", "unit"
    )

    def verify(batches):
        for table in tasks(batches, "key"):
            key, lo, hi = (table.column(n)[0].as_py() for n in ("key", "lo", "hi"))
            units = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64)
            units = units.reshape(table.num_rows, -1)
            if (key >> 20) & 0xFFFFF == key & 0xFFFFF:
                linked = compare_at_home(table.column("home").to_numpy(), units, key)
                counted = linked.copy()
            else:
                pivots = np.array(table.column("pivots").to_pylist())
                linked, counted = compare(pivots, units, key)
            if lo != hi:
                part = table.column("part").to_numpy()
                across = part[:, None] != part[None, :]
                linked &= across
                counted &= across
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                continue
            node = table.column("node").to_numpy()
            total = counted @ table.column("copies").to_numpy()
            root = node[some[roots(linked[np.ix_(some, some)])]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[some]), pa.array(root), pa.array(total[some])], schema=LINK_ARROW
            )

    return dealt(in_blocks(members, "key", "node", BLOCK), "key").mapInArrow(verify, LINK)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding;
    other columns are not looked at).

    Vectors that are null, empty, zero or hold null or non-finite components, and those without
    vec_id, link with nothing; vectors of different lengths don't link either. Rows that repeat a
    vector are linked with each other, whatever their ids, and each counts. A row that links with
    nothing has itself as component. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", "embedding").withColumn(
        "usable", usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    )
    classes = stored(
        rows.filter("usable")
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    found = stored(links(index(classes)), "links")
    counts = found.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.join(groups.withColumnRenamed("node", "g_node"), F.col("node") == F.col("g_node"))
    firsts = named.groupBy(F.col("component").alias("f_component")).agg(
        F.min("first_id").alias("group_id")
    )
    placed = (
        classes.join(groups.withColumnRenamed("node", "g_node"), F.col("node") == F.col("g_node"), "left")
        .join(firsts, F.col("component") == F.col("f_component"), "left")
        .join(counts, F.col("node") == F.col("l_node"), "left")
        .select(
            F.col("embedding").alias("c_embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("c_links"),
            F.coalesce("group_id", "first_id").alias("c_id"),
        )
    )
    good = rows.filter("usable").join(placed, F.col("embedding") == F.col("c_embedding"))
    out = good.select("vec_id", F.col("c_links").alias("n_links"), F.col("c_id").alias("component_id"))
    rest = rows.filter("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return out.unionByName(rest).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
