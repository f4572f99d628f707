import numpy as np

from fleetscan.llm import media


def _picture(seed, n=12, cell=8):
    grey = np.random.default_rng(seed).integers(20, 235, (n, n)).astype(np.uint8)
    return np.repeat(np.repeat(grey, cell, axis=0), cell, axis=1)


def _table(spark, pictures):
    rows = [(i, *p.shape, np.ascontiguousarray(p).tobytes(), "x") if p is not None else (i, None, None, None, "x") for i, p in pictures]
    return spark.createDataFrame(
        rows, "image_id long, height int, width int, pixels binary, key string"
    )


def test_crops_turns_and_edits_are_found(spark):
    pictures, copies = [], {}
    for k in range(30):
        p = _picture(k)
        pictures.append((10 * k, p))
        edits = [p[4:, 6:], np.rot90(p), np.clip(p * 0.8 + 15, 0, 255).astype(np.uint8), p]
        for n, e in enumerate(edits[k % 4 :][:2], 1):
            pictures.append((10 * k + n, e))
            copies[10 * k + n] = 10 * k
    got = {r.image_id: r.class_id for r in media.copies(_table(spark, pictures)).collect()}
    assert len(got) == len(pictures)
    assert np.mean([got[c] == got[o] for c, o in copies.items()]) > 0.9
    assert all(got[10 * k] == 10 * k for k in range(30))  # none meets another picture


def test_odd_images(spark):
    p = _picture(1)
    flat = np.full((96, 96), 9, np.uint8)
    rows = [(1, None), (2, flat), (3, flat[:5, :5]), (4, p), (4, p), (5, p), (None, p)]
    df = _table(spark, rows)
    got = sorted((r.image_id or 0, r.class_id or 0, r.n_corners > 0) for r in media.copies(df).collect())
    assert got == [(0, 0, False), (1, 1, False), (2, 2, False), (3, 3, False), (4, 4, True), (4, 4, True), (5, 4, True)]
    assert media.copies(df.limit(0)).count() == 0
    short = df.filter("image_id = 5").withColumn("width", df["width"] + 1)
    assert media.copies(short).first().n_corners == 0


def test_drawn_from_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.standard_normal(64).tolist()) for k in range(60)] + [(61, None), (62, [None]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.image_id: r.class_id for r in media.copies(media.drawn(df)).collect()}
    assert set(got) == {2 * k for k in range(63) if k != 60} | {1, 41, 81}
    assert sum(got[i] == i - 1 for i in (1, 41, 81)) >= 2


EDITS = {
    "cut at the edges": lambda p: p[10:, :-10],
    "the middle half": lambda p: p[48:144, 48:144],
    "a quarter": lambda p: p[:96, 96:],
    "half as large": lambda p: p.reshape(96, 2, 96, 2).mean(axis=(1, 3)).astype(np.uint8),
    "twice as large": lambda p: np.repeat(np.repeat(p, 2, axis=0), 2, axis=1),
    "turned": np.rot90,
    "turned and cut": lambda p: np.rot90(p, 3)[20:150, 30:],
    "darker": lambda p: np.clip(p * 0.8 + 15, 0, 255).astype(np.uint8),
}


def test_strong_edits_are_found_and_nothing_else(spark):
    """Each edit against all pictures and no other edit of its own."""
    pictures = [(100 * k, _picture(k, 24)) for k in range(16)]
    edits = [(100 * k + 1, list(EDITS.values())[k % len(EDITS)](p)) for k, (_, p) in enumerate(pictures)]
    got = {r.image_id: r.class_id for r in media.copies(_table(spark, pictures + edits)).collect()}
    assert np.mean([got[100 * k + 1] == 100 * k for k in range(16)]) >= 0.9
    assert all(got[100 * k] == 100 * k for k in range(16))


def _slow_classes(found):
    """All corners with all others by Hamming distance, votes by turn, ratio and shifted grids."""
    rows = [r.asDict() for r in found.collect()]
    words = np.array([[r["d0"], r["d1"]] for r in rows]).view(np.uint64)
    corners = {}
    for r in rows:
        corners[r["image_id"]] = corners.get(r["image_id"], 0) + 1
    votes = {}
    for k, a in enumerate(rows):
        far = np.bitwise_count(words ^ words[k]).sum(axis=1)
        for at in np.flatnonzero(far <= media.MOST_DIFFERENT):
            b = rows[at]
            if b["image_id"] >= a["image_id"]:
                continue
            step = 2 * np.pi / media.TURNS
            turn = round((b["angle"] - a["angle"]) / step) % media.TURNS
            ratio = media.SCALES[b["scale"]] / media.SCALES[a["scale"]]
            cos, sin = np.cos(turn * step), np.sin(turn * step)
            tx = b["x"] - ratio * (cos * a["x"] - sin * a["y"])
            ty = b["y"] - ratio * (sin * a["x"] + cos * a["y"])
            for grid in range(4):
                bx, by = np.floor(tx / media.SHIFT + grid % 2 / 2), np.floor(ty / media.SHIFT + grid // 2 / 2)
                spot = (round(a["x"] / media.SPOT), round(a["y"] / media.SPOT))
                votes.setdefault((a["image_id"], b["image_id"]), {}).setdefault((turn, ratio, grid, bx, by), set()).add(spot)
    root = {i: i for i in corners}

    def top(i):
        return i if root[i] == i else top(root[i])

    for (a, b), spots in votes.items():
        best = max(map(len, spots.values()))
        if best >= media.LEAST_VOTES and best * media.CORNERS_PER_VOTE >= min(corners[a], corners[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in corners}


def test_against_all_pairs_of_corners(spark):
    """Entries of tables lose few of the links that comparing everything finds, and add none."""
    pictures = []
    for k in range(14):
        p = _picture(k % 9, 14)
        p = p if k < 9 else p[3 * k % 20 :, : -1 - k]
        noise = np.random.default_rng(100 + k).normal(0, 4, p.shape)
        pictures.append((k, np.clip(p + noise, 0, 255).astype(np.uint8)))
    df = _table(spark, pictures)
    want = _slow_classes(media.described(df))
    got = {r.image_id: r.class_id for r in media.copies(df).collect()}
    pairs = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    assert len(pairs) >= 5 and np.mean([got[a] == got[b] for a, b in pairs]) >= 0.9
    assert all(want[a] == want[b] for a in want for b in want if got[a] == got[b])


def test_members_that_the_first_image_does_not_link_meet(spark, monkeypatch):
    """A copy pair shares its entries with an unlinked image of smaller id."""
    def rows(shared):
        out, parts = [], np.zeros((1, 2), np.uint64)
        key = int(media._mixed(parts, 0)[0])
        for image, other in ((1, 0), (2, 1), (3, 1)):
            for c in range(6):
                # equal in the first two parts, far or near in the others
                d1 = c * 0x0101 + other * ((2**30 - 1) << 30)
                out.append((image, c, 20.0 + 9 * c, 20.0 + 31 * (c % 3), 0, 0.5, 0, d1, [key if shared else 100 * image + c]))
        return spark.createDataFrame(out, media.CORNERS)

    found = rows(True)
    first = media.links(media.lead_matches(found), found).collect()
    assert first == []  # both are far from the first image, which leads all entries
    labels = spark.createDataFrame([], "node long, component long")
    for block in (512, 2):
        monkeypatch.setattr(media, "BLOCK", block)
        more = media.links(media.other_matches(found, labels), found).collect()
        assert [(r.image_id, r.lead, r.votes) for r in more] == [(3, 2, 6)]
    known = spark.createDataFrame([(2, 2), (3, 2)], labels.schema)
    assert media.links(media.other_matches(found, known), found).count() == 0
    assert media.other_matches(rows(False), labels).count() == 0


def test_equal_images_are_one(spark):
    p = _picture(5)
    found = media.described(_table(spark, [(7, p), (3, p), (9, p[1:]), (4, _picture(6)), (5, None)]))
    got = {r.image_id: r.same_as for r in media.representatives(found).collect()}
    assert got == {3: 3, 7: 3, 9: 9, 4: 4}


def test_corners_grow_with_the_area():
    small, large = (len(media.corners(_picture(1, n)[None])) for n in (14, 56))
    assert large > 12 * small
    huge = media.corners(np.zeros((1, 40, 3000), np.uint8))
    assert huge == []


def test_all_pairs_come_in_pieces_and_once():
    for n, most in ((0, 4), (1, 4), (2, 1), (7, 5), (40, 100), (40, 1 << 16)):
        got = [(int(x), int(y)) for a, b in media._all_pairs(n, most) for x, y in zip(a, b)]
        assert got == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_corners_that_share_tables_meet_once():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**63, (1, 2)).astype(np.uint64)
    parts = media._parts(words)
    for t, chosen in enumerate(media.TABLES):
        assert media._table_of(int(media._mixed(parts[:, list(chosen)], t)[0]), words) == t
    for bits in range(16):
        differ = np.array([[sum(1 << (32 * (1 - k)) for k in (0, 1) if bits >> k & 1), sum(1 << (32 * (1 - k)) for k in (0, 1) if bits >> (k + 2) & 1)]], np.uint64)
        shared = [t for t, (a, b) in enumerate(media.TABLES) if not (bits >> a & 1 or bits >> b & 1)]
        meets = [t for t in shared if not media._in_earlier_table(differ, t)[0]]
        assert meets == shared[:1]


def test_images_that_share_few_spots_do_not_meet(spark, monkeypatch):
    # 40 images alike at four spots and apart elsewhere: 780 pairs, none of which can be linked
    rng = np.random.default_rng(4)
    shared = rng.integers(-(2**63), 2**63, (4, 2))
    pairs = {k: rng.integers(-(2**63), 2**63, (8, 2)) for k in range(20)}
    rows = []
    for image in range(40):
        # two and two of them are alike at eight more spots
        own = np.concatenate((shared, pairs[image // 2]))
        for c, (d0, d1) in enumerate(own.tolist()):
            parts = np.array([[d0, d1]]).view(np.uint64)
            keys = [int(media._mixed(media._parts(parts)[:, list(t)], k)[0]) for k, t in enumerate(media.TABLES)]
            rows.append((image, c, 20.0 * c, 7.0 * c, 0, 0.0, d0, d1, keys))
    found = spark.createDataFrame(rows, media.CORNERS)
    labels = spark.createDataFrame([], "node long, component long")
    want = [(k + 1, k) for k in range(0, 40, 2)]
    for block, most in ((512, 256), (8, 256), (512, 3)):
        monkeypatch.setattr(media, "BLOCK", block)
        monkeypatch.setattr(media, "MOST_SKETCHED", most)
        matches = media.other_matches(found, labels)
        assert sorted((r.image_id, r.lead) for r in media.links(matches, found).collect()) == want
        # images that have more corners than are sent along are compared all the same
        assert matches.count() == (20 * 12 if most == 256 else 20 * 12 + (780 - 20) * 4)
