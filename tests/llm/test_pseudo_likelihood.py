import zlib

import numpy as np
import pytest

from fleetscan.llm import pseudo_likelihood as pl


def _slow(p, own):
    """The sum of conditional log-probabilities, token by token."""
    padded, total = [0, 0, *own, 0, 0], 0.0
    for i in range(2, len(own) + 2):
        h = p["bias"].astype(float).copy()
        for k, d in enumerate(pl.WINDOW):
            h += p["embed"][k][padded[i + d]]
        h = np.tanh(h)
        group, inner = divmod(padded[i], pl.CLASSES)
        upper = h @ p["upper"] + p["upper_bias"]
        lower = h @ p["lower"][group] + p["lower_bias"][group]
        total += upper[group] - np.log(np.exp(upper).sum())
        total += lower[inner] - np.log(np.exp(lower).sum())
    return total


def _model():
    words = pl.Vocabulary({w: k + 1 for k, w in enumerate("the cat sat on mat dog a".split())})
    counts = np.arange(pl.VOCABULARY, 0, -1.0)
    p = pl.starting_parameters(counts)
    return words, {k: v * 3 if v.ndim > 1 and k != "lower_bias" else v for k, v in p.items()}


def test_scores_are_those_of_the_slow_way(monkeypatch):
    words, p = _model()
    monkeypatch.setattr(pl, "BLOCK", 7)
    texts = ["the cat sat on the mat", None, "", "dog", "the unknown zebra sat", "a dog on a mat " * 9]
    tokens = [pl.tokens(t, words) for t in texts]
    for own, (n, total) in zip(tokens, pl.score_tokens(tokens, p)):
        assert n == len(own)
        assert abs(total - _slow(p, own)) < 1e-3


def test_a_token_is_not_its_own_context():
    words, p = _model()
    own = pl.tokens("the cat sat on the", words)
    one, other = own.copy(), own.copy()
    other[2] = 6
    pad = np.zeros(2, np.uint16)
    a, b = (pl.log_probabilities(p, np.concatenate((pad, x, pad))) for x in (one, other))
    everything = np.exp([
        pl.log_probabilities(p, np.concatenate((pad, own[:2], np.array([v], np.uint16), own[3:], pad)))[2] for v in range(pl.VOCABULARY)
    ]).sum()
    assert abs(everything - 1) < 1e-3 and a[2] != b[2]


def test_gradients_agree_with_differences():
    _, p = _model()
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, pl.VOCABULARY, (4, 50)), rng.integers(0, pl.VOCABULARY, 50)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    _, g = pl.gradients(p, context, target)
    for k, at in (("upper", (3, 5)), ("upper_bias", (4,)), ("bias", (7,)), ("lower", (2, 3, 4)), ("lower_bias", (2, 9))):
        high, low = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        high[k][at] += 1e-4
        low[k][at] -= 1e-4
        slope = (pl.gradients(high, context, target)[0] - pl.gradients(low, context, target)[0]) / 2e-4
        assert abs(slope - g[k][at]) < 1e-3 * max(1, abs(slope)), k
    rows, values = g["embed"][1]
    high, low = ({n: v.copy() for n, v in p.items()} for _ in range(2))
    high["embed"][1, rows[3], 2] += 1e-4
    low["embed"][1, rows[3], 2] -= 1e-4
    slope = (pl.gradients(high, context, target)[0] - pl.gradients(low, context, target)[0]) / 2e-4
    assert abs(slope - values[3][2]) < 1e-3


def test_training_beats_word_shares_and_prefers_real_order(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    known = docs.filter("doc_id % 4 <> 0")
    counts = pl.word_counts(known)
    lexicon = pl.most_frequent(counts)
    p = pl.train(pl.tokenised(known, lexicon), counts, lexicon)
    words = pl.Vocabulary(lexicon.vocabulary)
    texts = [r.text for r in docs.filter("doc_id % 4 = 0").limit(100).collect()]
    counts = sum(np.bincount(pl.tokens(t, words), minlength=pl.VOCABULARY) for t in texts)

    def mean(parameters, of):
        found = pl.score_tokens([pl.tokens(t, words) for t in of], parameters)
        return sum(x for _, x in found) / sum(n for n, _ in found)

    rng = np.random.default_rng(1)
    mixed = [" ".join(rng.permutation(t.split())) for t in texts]
    assert mean(p, texts) > mean(pl.starting_parameters(counts.astype(float)), texts) + 0.2
    assert mean(p, texts) > mean(p, mixed)


def test_odd_documents(spark, odd_docs, odd_texts, no_docs):
    rows = pl.pseudo_likelihoods(odd_docs).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.n_tokens, r.pseudo_log_likelihood, r.per_token) == (0, 0.0, None)
        else:
            assert r.pseudo_log_likelihood < 0 and r.n_tokens > 0
    same = {r.pseudo_log_likelihood for r in rows if r.doc_id in (6, 7, 8, None)}
    assert max(same) - min(same) < 1e-3
    assert pl.pseudo_likelihoods(no_docs).count() == 0


@pytest.mark.parametrize("head", [0, 2, 100])
def test_every_word_counts(spark, head):
    """A word outside the vocabulary counts with its share in its bucket, whether tasks know its
    count or it is joined."""
    texts = ["the cat sat on the mat", "the flat cat", "the zat", None, "the the the the cat cat sat sat flat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = pl.word_counts(docs)
    own = {"on": 1, "mat": 1, "flat": 2, "zat": 1}
    assert {r.word: r.n for r in counts.collect()} == own | {"the": 8, "cat": 4, "sat": 3}
    vocabulary = {"the": 1, "cat": 2, "sat": 3}
    buckets = np.zeros(pl.BUCKETS)
    for w, n in own.items():
        buckets[zlib.crc32(w[-2:].encode()) % pl.BUCKETS] += n
    lexicon = pl.Lexicon(vocabulary, dict(list(own.items())[:head]), buckets)
    p = pl.starting_parameters(np.ones(pl.VOCABULARY))
    more = docs.union(spark.createDataFrame([(5, "the xyzat"), (6, "the mat")], docs.schema))
    got = {r.doc_id: r for r in pl.scored(pl.tokenised(more, lexicon), p, counts).collect()}
    sums = {}
    for w, n in own.items():
        sums[w[-2:]] = sums.get(w[-2:], 0) + n
    rows = [(r.doc_id, r.text) for r in more.collect()]
    tokens = [pl.tokens(t, pl.Vocabulary(lexicon.vocabulary)) for _, t in rows]
    for (doc, text), (n, total) in zip(rows, pl.score_tokens(tokens, p)):
        inside = sum(
            np.log(own.get(w, pl.UNSEEN) / (sums.get(w[-2:], 0) + pl.UNSEEN))
            for w in (text or "").split() if w not in vocabulary
        )
        assert got[doc].n_tokens == n and abs(got[doc].pseudo_log_likelihood - total - inside) < 1e-6
        assert got[doc].per_token is None if n == 0 else abs(got[doc].per_token - (total + inside) / n) < 1e-6
    assert got[6].per_token > got[5].per_token  # a word that was never seen is less likely


def test_one_split_for_counts_and_scores(spark):
    """Only space and the controls 9 to 13 separate words, everywhere."""
    text = "foo\xa0bar foo\x1cbar\tfoo\u2003bar FOO\x0bfoo"
    words = ["foo\xa0bar", "foo\x1cbar", "foo\u2003bar", "foo", "foo"]
    assert pl.words_in(text) == words and pl.words_in("a\x0cb  c ") == ["a", "b", "c"]
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    counts = pl.word_counts(docs)
    assert {r.word: r.n for r in counts.collect()} == {w: words.count(w) for w in words}
    lexicon = pl.most_frequent(counts)
    p = pl.starting_parameters(np.ones(pl.VOCABULARY))
    assert [r.n_tokens for r in pl.scored(pl.tokenised(docs, lexicon), p, counts).orderBy("doc_id").collect()] == [5, 0]


def test_the_most_frequent_words(spark, monkeypatch):
    counts = spark.createDataFrame([(f"w{k:04}", 5000 - k // 2) for k in range(1500)], pl.COUNTS)
    monkeypatch.setattr(pl, "HEAD", 300)
    lexicon = pl.most_frequent(counts)
    assert list(lexicon.vocabulary) == [f"w{k:04}" for k in range(pl.WORDS)] and lexicon.vocabulary["w0000"] == 1
    assert lexicon.head == {f"w{k:04}": 5000 - k // 2 for k in range(pl.WORDS, pl.WORDS + 300)}
    total = sum(5000 - k // 2 for k in range(pl.WORDS, 1500))
    assert abs((np.exp(lexicon.under[1 + pl.WORDS :]) - pl.UNSEEN).sum() - total) < 1e-3


def test_words_are_forgotten_when_there_are_too_many(monkeypatch):
    lexicon = pl.Lexicon({"the": 1}, {"cat": 3}, np.ones(pl.BUCKETS))
    want = pl.Reader(lexicon).read("the cat zat yat xat the zat")
    monkeypatch.setattr(pl, "REMEMBERED", 1)
    reader = pl.Reader(lexicon)
    got = reader.read("the cat zat yat xat the zat")
    assert (got[0] == want[0]).all() and got[1:] == want[1:] and got[2] == ["zat", "yat", "xat", "zat"]
    assert reader.numbers["the"] == 1 and len(reader.numbers) <= reader.learned + 2


def test_every_position_is_a_target_in_some_round(monkeypatch):
    monkeypatch.setattr(pl, "BATCH", 10**9)
    _, p = _model()
    for n in (1, 2, 3, 10, 37):
        own = np.arange(1, n + 1)
        seen = set()
        for turn in range(pl.ROUNDS):
            trainer = pl.Trainer(p)
            trainer.add(own, turn)
            seen |= set(trainer.waiting[0][-1].tolist())
        assert seen == set(own.tolist())


def test_windows_of_a_batch_are_those_of_single_texts(monkeypatch):
    """Batches are cut from one line of texts; no window may see the text beside its own."""
    seen = []

    def watched(p, context, target):
        seen.extend(zip(map(tuple, context.T.tolist()), target.tolist()))
        return gradients(p, context, target)

    gradients = pl.gradients
    monkeypatch.setattr(pl, "gradients", watched)
    monkeypatch.setattr(pl, "BATCH", 50)
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, pl.VOCABULARY, n).astype(np.uint16) for n in (1, 2, 3, 0, 1, 7, 120, 4, 33)]
    for turn in range(pl.ROUNDS):
        seen.clear()
        trainer = pl.Trainer(pl.starting_parameters(np.ones(pl.VOCABULARY)))
        want = []
        for own in texts:
            trainer.add(own, turn)
            if len(own):
                first = (int(own[:4].sum(dtype=np.int64)) + turn) % pl.MASK
                first = first if first < len(own) else len(own) // 2
                padded = [0, 0, *own.tolist(), 0, 0]
                want += [(tuple(padded[k + 2 + d] for d in pl.WINDOW), padded[k + 2]) for k in range(first, len(own), pl.MASK)]
        trainer.step()
        assert seen == want and trainer.tokens == len(want)
