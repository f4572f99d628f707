"""Documents scored by masked pseudo-likelihood.

A small network predicts each token from a window on both of its sides, never from itself. It is
trained in numpy inside Spark tasks: every task starts from the same parameters, steps through the
masked positions of its documents, and the parameters are averaged by tokens seen, round
by round. A document's score is the sum of its words' conditional log-probabilities: the network's
for the token, and for words that share a token (a bucket) the word's share in its bucket.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, column_of, rows_to_batches, stored, summed_arrays

#: Tokens: 0 stands beyond a document's ends, then the most frequent words, then buckets of the
#: other words by their endings. The two-level softmax has CLASSES classes of as many tokens.
CLASSES = 32
VOCABULARY = CLASSES * CLASSES
BUCKETS = 63
WORDS = VOCABULARY - BUCKETS - 1
WINDOW = (-2, -1, 1, 2)
REACH = 2
HIDDEN = 24
#: In each round one position in MASK is predicted, another one each round: all of them in all.
ROUNDS = MASK = 2
BATCH = 8192
RATE = 0.1
#: Tokens scored at once.
BLOCK = 1 << 14
#: Words outside the vocabulary whose counts every task knows, the most frequent ones; the counts of
#: all others are joined.
HEAD = 200_000
#: Different words that a task counts before it passes them on.
COUNTED = 500_000
#: What a word that was never counted counts as in its bucket.
UNSEEN = 0.5
#: Words remembered by a task besides the vocabulary.
REMEMBERED = 500_000
SEED = 11
CHUNK = 1 << 12

#: What separates words: space and the ASCII controls 9 to 13. ``str.split`` knows more gaps than these.
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_OTHER_GAPS = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_in(text: str | None) -> list[str]:
    """The words of a text, in lower case; training, counts and scores all go by these."""
    small = text.lower() if text else ""
    return [w for w in _GAP.split(small) if w] if _OTHER_GAPS.search(small) else small.split()


class Vocabulary(dict):
    """Token numbers by word; words outside get a bucket when they are first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            for w in [w for w, k in self.items() if k > WORDS]:
                del self[w]
        self[word] = k = 1 + WORDS + zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % BUCKETS
        return k


def tokens(text: str | None, vocabulary: Vocabulary) -> np.ndarray:
    words = words_in(text)
    return np.fromiter(map(vocabulary.__getitem__, words), np.uint16, len(words))


# -- the network

SHAPES = {
    "embed": (len(WINDOW), VOCABULARY, HIDDEN),
    "bias": (HIDDEN,),
    "upper": (HIDDEN, CLASSES),
    "upper_bias": (CLASSES,),
    "lower": (CLASSES, HIDDEN, CLASSES),
    "lower_bias": (CLASSES, CLASSES),
}


def starting_parameters(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights, and the biases that give each token its share in ``counts``."""
    rng = np.random.default_rng(SEED)
    share = ((counts + 0.5) / (counts + 0.5).sum()).reshape(CLASSES, CLASSES)
    p = {k: rng.normal(0, 0.05, s).astype(np.float32) for k, s in SHAPES.items()}
    p["bias"][:] = 0
    p["upper_bias"] = np.log(share.sum(axis=1)).astype(np.float32)
    p["lower_bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float64)


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


#: Sums of short rows are faster as products.
_ONES = np.ones(CLASSES, np.float32)


def _softmax_parts(h: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """z = h w + b by rows, exp(z) up to a factor for each row, the sums of these, and the logs of the
    sums without the factor. No h is beyond 1, which bounds z; most often no factor is needed."""
    z = h @ w
    z += b
    if np.abs(w).sum(axis=0).max() + np.abs(b).max() < 60:
        e = np.exp(z)
        total = e @ _ONES
        return z, e, total, np.log(total)
    top = z.max(axis=1)
    e = np.exp(z - top[:, None])
    total = e @ _ONES
    return z, e, total, np.log(total) + top


def _segments(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows in the order of their class, and where each class lies in it."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    stops = np.cumsum(np.bincount(group, minlength=CLASSES))
    return order, [(c, int(a), int(b)) for c, (a, b) in enumerate(zip([0, *stops[:-1]], stops)) if b > a]


def log_probabilities(p: dict, padded: np.ndarray) -> np.ndarray:
    """For each token of ``padded`` but the outer two on both sides, its log-probability given
    the two before and the two behind."""
    n = len(padded) - 2 * REACH
    h = p["bias"] + sum(
        p["embed"][k].take(padded[REACH + d : REACH + d + n], axis=0) for k, d in enumerate(WINDOW)
    )
    np.tanh(h, out=h)
    group, inner = np.divmod(padded[REACH : REACH + n], CLASSES)
    order, segments = _segments(group)
    h, group, inner = h.take(order, axis=0), group[order], inner[order]
    z, _, _, log_total = _softmax_parts(h, p["upper"], p["upper_bias"])
    found = z[np.arange(n), group] - log_total
    for c, a, b in segments:
        z, _, _, log_total = _softmax_parts(h[a:b], p["lower"][c], p["lower_bias"][c])
        found[a:b] += z[np.arange(b - a), inner[a:b]] - log_total
    out = np.empty(n)
    out[order] = found
    return out


def gradients(p: dict, context: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """The summed loss of predicting ``target`` from ``context`` (a row for each place of the
    window), and its gradients; those of embeddings as (rows, values) for each place."""
    n = len(target)
    h = np.tanh(p["bias"] + sum(p["embed"][k].take(context[k], axis=0) for k in range(len(WINDOW))))
    group, inner = np.divmod(target, CLASSES)
    z, e, total, log_total = _softmax_parts(h, p["upper"], p["upper_bias"])
    at = np.arange(n), group
    loss = float((log_total - z[at]).sum())
    e /= total[:, None]
    e[at] -= 1
    g = {"upper": h.T @ e, "upper_bias": e.sum(axis=0)}
    g["lower"] = np.zeros(SHAPES["lower"], np.float32)
    g["lower_bias"] = np.zeros(SHAPES["lower_bias"], np.float32)
    dh = e @ p["upper"].T
    order, segments = _segments(group)
    own, inner, more = h.take(order, axis=0), inner[order], np.empty_like(dh)
    for c, a, b in segments:
        z, e, total, log_total = _softmax_parts(own[a:b], p["lower"][c], p["lower_bias"][c])
        at = np.arange(b - a), inner[a:b]
        loss += float((log_total - z[at]).sum())
        e /= total[:, None]
        e[at] -= 1
        g["lower"][c], g["lower_bias"][c] = own[a:b].T @ e, e.sum(axis=0)
        more[a:b] = e @ p["lower"][c].T
    back = np.empty_like(order)
    back[order] = np.arange(n)
    dh += more.take(back, axis=0)
    dh *= 1 - h * h
    g["bias"] = dh.sum(axis=0)
    g["embed"] = []
    for k in range(len(WINDOW)):
        # short integers are sorted by their digits
        order = np.argsort(context[k], kind="stable")
        at = context[k][order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        g["embed"].append((at[first], np.add.reduceat(dh.take(order, axis=0), first, axis=0)))
    return loss, g


_GAP_TOKENS = np.zeros(REACH, np.uint16)


class Trainer:
    """Adagrad steps on batches of masked positions."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v.copy() for k, v in p.items()}
        self.seen = {k: np.full(v.shape, 1e-8, np.float32) for k, v in p.items()}
        self.tokens = 0
        self._forget()

    def _forget(self) -> None:
        self.waiting: list[np.ndarray] = [_GAP_TOKENS]
        self.places: list[np.ndarray] = []
        self.held, self.end = 0, REACH

    def add(self, own: np.ndarray, turn: int) -> None:
        """Take one position in MASK of a document's tokens; which one follows from the tokens."""
        if not len(own):
            return
        first = (int(own[: 2 * REACH].sum(dtype=np.int64)) + turn) % MASK
        if first >= len(own):
            first = len(own) // 2
        # the gap that REACH zeros leave behind a text stands before the next one, too
        self.places.append(np.arange(self.end + first, self.end + len(own), MASK))
        self.waiting += (own, _GAP_TOKENS)
        self.end += len(own) + REACH
        self.held += len(self.places[-1])
        if self.held >= BATCH:
            self.step()

    def step(self) -> None:
        if not self.held:
            return
        line, at = np.concatenate(self.waiting), np.concatenate(self.places)
        self._forget()
        n = len(at)
        self.tokens += n
        _, g = gradients(self.p, np.stack([line[at + d] for d in WINDOW]), line[at])
        scale = np.float32(1 / n)
        for k in SHAPES:
            if k == "embed":
                for place, (at, value) in enumerate(g["embed"]):
                    value = value * scale
                    self.seen[k][place][at] += value * value
                    self.p[k][place][at] -= RATE * value / np.sqrt(self.seen[k][place][at])
            else:
                value = g[k] * scale
                self.seen[k] += value * value
                self.p[k] -= RATE * value / np.sqrt(self.seen[k])


# -- the operator


COUNTS = "word string, n long"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            words = pa.array(list(counts), pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in column_of(batch, "text"):
                counts.update(words_in(text.as_py()))
                if len(counts) >= COUNTED:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """What every task knows of words, of a bounded size: the vocabulary, the counts of the most
    frequent words outside it, and how often the words of each bucket occur."""

    def __init__(self, vocabulary: dict[str, int], head: dict[str, int], bucket_counts: np.ndarray):
        self.vocabulary = vocabulary
        self.head = head
        #: Log of what stands under the share of a word in its bucket, by token.
        self.under = np.zeros(VOCABULARY)
        self.under[1 + WORDS :] = np.log(bucket_counts + UNSEEN)


def most_frequent(counts: DataFrame) -> Lexicon:
    """The lexicon of stored ``counts``; ties go by word. Besides the words, one number for each
    bucket comes to the driver."""
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS + HEAD).toArrow()
    words, n = top.column("word").to_pylist(), top.column("n").to_pylist()
    rare = counts.join(
        F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in words[:WORDS]], "word string")),
        "word", "left_anti",
    )
    sums = rare.groupBy(_bucket(F.col("word")).alias("bucket")).agg(F.sum("n").alias("n")).collect()
    buckets = np.zeros(BUCKETS)
    for r in sums:
        buckets[r.bucket] = r.n
    vocabulary = {w: k + 1 for k, w in enumerate(words[:WORDS])}
    return Lexicon(vocabulary, dict(zip(words[WORDS:], n[WORDS:])), buckets)


def _gather(rows: DataFrame, run) -> dict[str, np.ndarray]:
    parts = rows.mapInArrow(run, "key string, data binary")
    return {r["key"]: np.frombuffer(r["data"], np.float64) for r in summed_arrays(parts, "float64").collect()}


def _chunks(x: np.ndarray):
    for k in range(0, len(x), CHUNK):
        yield pa.RecordBatch.from_pydict({"key": [str(k)], "data": [x[k : k + CHUNK].tobytes()]})


def _whole(found: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n)
    for key, part in found.items():
        out[int(key) : int(key) + len(part)] = part
    return out


TOKENS = "row long, doc_id long, tokens binary, inside double, word string"
TOKENS_ARROW = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("tokens", pa.binary()),
        ("inside", pa.float64()),
        ("word", pa.string()),
    ]
)
#: Rows, of documents or of rare words, in one batch; bytes of tokens, too.
TOKEN_ROWS = 1 << 16
TOKEN_BYTES = 1 << 23


class Reader:
    """Texts to tokens, and the logs of the shares of their words in their buckets. Numbers of words
    behind the tokens' tell words of a known count, the last ones rare words by their bucket."""

    def __init__(self, lexicon: Lexicon):
        head = list(lexicon.head)
        known = Vocabulary({w: k for w, k in lexicon.vocabulary.items()})
        self.numbers: dict[str, int] = dict(lexicon.vocabulary)
        self.first_rare = VOCABULARY + len(head)
        bucket = np.array([known[w] for w in head], np.int64)
        self.numbers.update((w, VOCABULARY + k) for k, w in enumerate(head))
        rare = np.arange(1 + WORDS, VOCABULARY)
        self.token = np.concatenate((np.arange(VOCABULARY), bucket, rare)).astype(np.uint16)
        logs = np.log(np.array(list(lexicon.head.values()), float)) - lexicon.under[bucket]
        self.share = np.concatenate((np.zeros(VOCABULARY), logs, -lexicon.under[rare]))
        self.learned = len(self.numbers)

    def number(self, word: str) -> int:
        found = self.numbers.get(word)
        if found is None:
            if len(self.numbers) > self.learned + REMEMBERED:
                self.numbers = dict(list(self.numbers.items())[: self.learned])
            bucket = zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % BUCKETS
            self.numbers[word] = found = self.first_rare + bucket
        return found

    def read(self, text: str | None) -> tuple[np.ndarray, float, list[str]]:
        """Tokens, summed logs (without the counts of rare words) and the rare words."""
        words = words_in(text)
        own = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))
        for k in np.flatnonzero(own < 0):
            own[k] = self.number(words[k])
        rare = np.flatnonzero(own >= self.first_rare)
        return self.token[own], float(self.share[own].sum()), [words[k] for k in rare]


def tokenised(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A row for each document: row, doc_id, tokens (16-bit numbers) and inside, the logs of the shares
    of its words in their buckets but for the counts of rare words; and a row (row, word) for each
    occurrence of such a word."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            rows, docs = column_of(batch, "row").to_numpy(), column(batch, "doc_id")
            found, rare, owners, counts, size, start = [], [], [], [], 0, 0
            for k, text in enumerate(column_of(batch, "text")):
                own, inside, words = reader.read(text.as_py())
                found.append((own.astype("<u2").tobytes(), inside))
                size += own.nbytes
                if words:
                    rare += words
                    owners.append(rows[k])
                    counts.append(len(words))
                if size >= TOKEN_BYTES or len(rare) >= TOKEN_ROWS or k == batch.num_rows - 1:
                    tokens, inside = zip(*found)
                    yield _token_rows(
                        row=pa.array(rows[start : k + 1]),
                        doc_id=pa.array(docs[start : k + 1], pa.int64()),
                        tokens=pa.array(tokens, pa.binary()),
                        inside=pa.array(inside, pa.float64()),
                    )
                    if rare:
                        yield _token_rows(
                            row=pa.array(np.repeat(np.array(owners, np.int64), counts)), word=pa.array(rare, pa.string())
                        )
                    found, rare, owners, counts, size, start = [], [], [], [], 0, k + 1

    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text")
    )
    return texts.mapInArrow(run, TOKENS)


def _token_rows(row: pa.Array, **given: pa.Array) -> pa.RecordBatch:
    columns = [given.get(f.name, pa.nulls(len(row), f.type)) for f in list(TOKENS_ARROW)[1:]]
    return pa.RecordBatch.from_arrays([row, *columns], schema=TOKENS_ARROW)


def train(read: DataFrame, counts: DataFrame, lexicon: Lexicon) -> dict[str, np.ndarray]:
    """Parameters learned from the stored tokens of all texts. The driver gets one set of summed
    parameters for each round, whatever the number of tasks."""
    spark = read.sparkSession
    documents = read.filter("tokens is not null").select("tokens")
    shared = spark.sparkContext.broadcast(lexicon.vocabulary)

    def count(batches):
        known, total = Vocabulary(shared.value), np.zeros(VOCABULARY)
        for batch in batches:
            own = [known[w] for w in column(batch, "word")]
            total += np.bincount(own, column(batch, "n"), VOCABULARY)
        yield from _chunks(total)

    p = starting_parameters(_whole(_gather(counts, count), VOCABULARY))
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(p)

        def learn(batches, start=start, turn=turn):
            trainer = Trainer(start.value)
            for batch in batches:
                for data in column(batch, "tokens"):
                    trainer.add(np.frombuffer(data, "<u2"), turn)
            trainer.step()
            if trainer.tokens:
                yield from _chunks(np.append(flat(trainer.p), 1.0) * trainer.tokens)

        n = len(flat(p))
        total = _whole(_gather(documents, learn), n + 1)
        if total[-1]:
            p = unflat(total[:-1] / total[-1])
    return p


def score_tokens(own: list[np.ndarray], p: dict) -> list[tuple[int, float]]:
    """(tokens, summed log-probability) of each text. Texts are scored in runs of tokens with
    the outside token between them; a text of any length is cut into overlapping runs."""
    gap = np.zeros(REACH, np.uint16)
    line = np.concatenate([gap, *[x for t in own for x in (t, gap)]])
    sizes = np.array([len(t) for t in own], np.int64)
    logs = np.zeros(len(line))
    for a in range(0, len(line) - 2 * REACH, BLOCK):
        part = line[a : a + BLOCK + 2 * REACH]
        logs[a + REACH : a + len(part) - REACH] = log_probabilities(p, part)
    starts = REACH + np.cumsum(sizes + REACH) - sizes - REACH
    return [(int(n), float(logs[s : s + n].sum())) for s, n in zip(starts, sizes)]


SCORED = "row long, doc_id long, n_tokens long, total double"
SCORED_ARROW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("total", pa.float64())]
)


def _bucket(word: Column) -> Column:
    return F.crc32(F.encode(F.right(word, F.lit(2)), "UTF-8")) % BUCKETS


def scored(read: DataFrame, p: dict, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood and per_token of every document of the stored table
    ``read`` (see :func:`tokenised`); ``counts`` are those of :func:`word_counts`.

    A text that is null or has no words has no tokens, a sum of 0 and a null mean. Rows that
    repeat are scored alike. An empty table gives an empty result.
    """
    shared = read.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        def rows():
            for batch in batches:
                own = [np.frombuffer(t, "<u2") for t in column(batch, "tokens")]
                found = zip(column(batch, "row"), column(batch, "doc_id"), column(batch, "inside"), score_tokens(own, shared.value))
                for row, doc, inside, (n, total) in found:
                    yield 32, (row, doc, n, total + inside)

        yield from rows_to_batches(rows(), SCORED_ARROW)

    documents = read.filter("tokens is not null").select("row", "doc_id", "tokens", "inside")
    both = documents.mapInArrow(run, SCORED)
    rare = counts.select(F.col("word").alias("c_word"), "n")
    inside = (
        read.filter("word is not null")
        .select(F.col("row").alias("i_row"), "word")
        .join(rare, F.col("word") == F.col("c_word"), "left")
        .select("i_row", F.log(F.coalesce("n", F.lit(UNSEEN))).alias("share"))
        .groupBy("i_row")
        .agg(F.sum("share").alias("rare"))
    )
    total = F.col("total") + F.coalesce("rare", F.lit(0.0))
    return both.join(inside, F.col("row") == F.col("i_row"), "left").select(
        "doc_id",
        "n_tokens",
        total.alias("pseudo_log_likelihood"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"),
    )


def pseudo_likelihoods(docs: DataFrame) -> DataFrame:
    """Every document scored by a network trained on all of them."""
    counts = stored(word_counts(docs), "words")
    lexicon = most_frequent(counts)
    read = stored(tokenised(docs, lexicon), "tokens")
    return scored(read, train(read, counts, lexicon), counts)
