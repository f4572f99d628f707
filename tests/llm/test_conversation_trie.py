import hashlib
import zlib

import numpy as np
import pytest

from fleetscan.llm import conversation_trie as trie


def _slow_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(first, [])[:h] + ts[h:]
    return out


def _slow(sequences):
    """All nodes from a dictionary of prefixes; sums by walking every prefix's ancestors."""
    members, ends = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        str((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        ))
        for p, m in members.items()
    )


def _frame(spark, rows):
    return spark.createDataFrame(
        [(c, t, r, x, 1, b"k") for c, t, r, x in rows],
        "conv_id long, turn long, role string, text string, depth int, key binary",
    )


def _got(frame):
    assert frame.columns == trie.COLUMNS
    return sorted(str(tuple(r)) for r in frame.collect())


ROWS = [
    *((c, t, "user" if t % 2 == 0 else "assistant", f"{'same' if c % 3 else 'other'} {t} {c // 7 if t > 3 else ''}")
      for c in range(0, 230) for t in range(1 + c % 9)),
    *((c, t, "user", "hot") for c in range(300, 420) for t in range(7)),
    (500, None, None, None), (500, None, "user", "é𝄞"), (500, 0, "user", ""), (501, 3, "", None), (501, 3, "", None),
    *((599, t, "user", f"x{t}") for t in range(120)),
    *((600, t, "user", f"x{t}") for t in range(121)), *((601, t, "user", f"x{t}") for t in range(121)),
    (-5, 0, "user", "negative"), (-105, 0, "user", "a"), (-105, 1, "user", "b"),
    (None, 0, "user", "of no conversation"), (777, 0, "user", "its hundred has no first"),
]


@pytest.mark.parametrize("turns, block, fan", [(1_000_000, 16, 256), (40, 4, 3), (9, 1, 2)])
def test_against_prefixes(spark, monkeypatch, turns, block, fan):
    monkeypatch.setattr(trie, "SHARD_TURNS", turns)
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "FAN", fan)
    assert _got(trie.conversation_trie(_frame(spark, ROWS))) == _slow(_slow_rebuilt(ROWS))


def test_equal_conversations_on_many_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_TURNS", 50)
    monkeypatch.setattr(trie, "FAN", 4)
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(8)]
    got = trie.conversation_trie(_frame(spark, rows))
    assert _got(got) == _slow(_slow_rebuilt(rows))


def test_random_shards(monkeypatch):
    """The shard alone, with short and long rows and blocks narrower than they are."""
    rng = np.random.default_rng(3)
    for width in (1, 2, 5):
        monkeypatch.setattr(trie, "BLOCK", width)
        seqs = {c: [("", f"{rng.integers(0, 2)}") for _ in range(rng.integers(0, 8))] for c in range(40)}
        ids = {t: hashlib.md5(t[1].encode()).digest() for s in seqs.values() for t in s}
        keys = {c: b"".join(ids[t] for t in s) for c, s in seqs.items()}
        shard = trie._Shard(
            np.array(list(seqs)), np.array([len(s) for s in seqs.values()]),
            np.frombuffer(b"".join(keys.values()), ">u8").reshape(-1, 2),
            np.array([1 for s in seqs.values() for _ in s]),
        )
        ordered = sorted(keys.values())
        assert (shard.first, shard.last) == (len(ordered[0]) // 16, len(ordered[-1]) // 16)
        assert [len(x.conv) for x in shard.levels] == [
            len({k[: 16 * d] for k in ordered if len(k) >= 16 * d}) for d in range(len(shard.levels))
        ]


def test_odd_tables(spark):
    assert _got(trie.conversation_trie(_frame(spark, ROWS).limit(0))) == []
    only = [(123, 0, "user", "gone: its first turns are those of conversation 100, which is not here")]
    assert _got(trie.conversation_trie(_frame(spark, only))) == _slow(_slow_rebuilt(only))
