"""Quality scores from a sparse ensemble of rules.

Statistics of each text are column expressions. Shallow trees grown on resampled, labelled rows
give conjunctive rules over them; a logistic regression with an L1 penalty keeps a few; the
rules that are left, with their weights, are compiled into one column expression again. So one
pass over the texts gives the statistics, and scoring needs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of

#: At most so many labelled rows are fitted to: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
TREES = 40
DEPTH = 3
LEAST_LEAF = 10
CUTS = 32
PENALTY = 0.001
STEPS = 1500
THRESHOLD = 0.3
SEED = 7


# -- statistics


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, all finite; of a null or empty text, all 0."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    signs = F.length(F.translate(t, "#$%&*!|<>{}[]=_^~+@/\\", "")) - n
    words = F.col("words")
    size = F.size(words)
    distinct = F.size(F.array_distinct(words))
    chars = F.greatest(n, F.lit(1))
    some = F.greatest(size, F.lit(1))
    return {
        "chars": F.log1p(n.cast("double")),
        "words": F.log1p(size.cast("double")),
        "letters": letters / chars,
        "capitals": capitals / F.greatest(letters, F.lit(1)),
        "digits": (n - F.length(F.translate(t, "0123456789", ""))) / chars,
        "signs": -signs / chars,
        "bangs": (n - F.length(F.translate(t, "!", ""))) / some,
        "bars": (n - F.length(F.translate(t, "|", ""))) / some,
        "stops": (n - F.length(F.translate(t, ".,", ""))) / some,
        "breaks": (n - F.length(F.translate(t, "\n", ""))) / some,
        "word_length": letters / some,
        "distinct": distinct / some,
        "room": distinct / F.sqrt(some),
    }


STATISTICS = [
    "chars", "words", "letters", "capitals", "digits", "signs", "bangs", "bars", "stops", "breaks",
    "word_length", "distinct", "room",
]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``, among them text) and one double for each statistic."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return (
        docs.select(F.struct("*").alias("row"))
        .select("row", text.alias("text"), F.split(F.trim(text), r"\s+").alias("words"))
        .select("row", *[c.cast("double").alias(f"q_{k}") for k, c in statistics(F.col("text")).items()])
    )


# -- fitting


@dataclass(frozen=True)
class Rule:
    """All of the conditions (statistic, is_above, threshold): above means >, else <=."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, cut in self.conditions:
            out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
        return out


@dataclass
class Ensemble:
    names: list[str]
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def score(self) -> Column:
        """The score as a column expression over the statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            test = F.lit(True)
            for k, above, cut in rule.conditions:
                c = F.col(f"q_{self.names[k]}")
                test = test & ((c > cut) if above else (c <= cut))
            z = z + F.when(test, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _grow(x, y, rows, cuts, rng, depth, path, found) -> None:
    if path:
        found.add(Rule(tuple(sorted(path))))
    if depth == 0 or len(rows) < 2 * LEAST_LEAF:
        return
    mean = y[rows].mean()
    if mean in (0.0, 1.0):
        return
    best, split = 1e-9, None
    for k in rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False):
        values, target = x[rows, k], y[rows]
        place = np.searchsorted(cuts[k], values, "left")
        n = np.cumsum(np.bincount(place, minlength=len(cuts[k]) + 1))[:-1]
        s = np.cumsum(np.bincount(place, target, minlength=len(cuts[k]) + 1))[:-1]
        m = len(rows) - n
        fit = (n >= LEAST_LEAF) & (m >= LEAST_LEAF)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fit, s * s / n + (target.sum() - s) ** 2 / m, 0) - len(rows) * mean**2
        top = int(gain.argmax())
        if fit[top] and gain[top] > best:
            best, split = gain[top], (int(k), float(cuts[k][top]))
    if split is None:
        return
    k, cut = split
    low = x[rows, k] <= cut
    for part, above in ((rows[low], False), (rows[~low], True)):
        _grow(x, y, part, cuts, rng, depth - 1, [*path, (k, above, cut)], found)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> list[Rule]:
    """The paths, from every node to its root, of trees grown on halves of the rows."""
    rng, found = np.random.default_rng(seed), set()
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 1)[1:-1])) for k in range(x.shape[1])]
    for _ in range(TREES):
        rows = rng.choice(len(x), size=max(1, len(x) // 2), replace=False)
        _grow(x, y, rows, cuts, rng, DEPTH, [], found)
    return sorted(found, key=lambda r: r.conditions)


def lasso(h: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic regression with an L1 penalty, by accelerated proximal
    gradient steps; the classes count by their numbers, so scores are shares."""
    n, k = h.shape
    bias, w = 0.0, np.zeros(k)
    held, moved, t = (bias, w), (bias, w), 1.0
    step = 4.0 / max(np.mean((h**2).sum(axis=1)) + 1, 1)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(moved[0] + h @ moved[1], -30, 30)))
        error = (p - y) / n
        bias = moved[0] - step * error.sum()
        w = moved[1] - step * (h.T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / nxt
        moved = (bias + pull * (bias - held[0]), w + pull * (w - held[1]))
        shift = np.abs(w - held[1]).max(initial=0) + abs(bias - held[0])
        held, t = (bias, w), nxt
        if shift < 1e-6:
            break
    return bias, w


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ensemble:
    """Without rows of both labels, the share of label 1 (one half without any)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(np.unique(y)) < 2:
        return Ensemble(names, float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble(names, float(np.log(share / (1 - share))))
    h = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    _, first = np.unique(h, axis=1, return_index=True)  # rules that hold for the same rows
    keep = np.sort(first)
    bias, w = lasso(h[:, keep], y)
    return Ensemble(
        names, float(bias), [(rules[i], float(v)) for i, v in zip(keep, w) if abs(v) > 1e-4]
    )


# -- the operator


def fit_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Statistics and label (y) of rows to learn from: not held out, label 0 or 1, of at most
    ``most`` labelled documents, by the hash of the id. A document labelled more than once counts
    as often. Statistics are computed for these rows alone; their ids are broadcast, which
    ``most`` bounds."""
    known = labels.filter(F.col("quality").isin(0, 1)).filter(fold_of(F.col("doc_id")) != 0)
    ids = docs.select(F.col("doc_id").alias("d_id")).distinct()
    chosen = (
        known.join(ids, F.col("doc_id") == F.col("d_id"))
        .select(F.col("doc_id").alias("l_id"), F.col("quality").cast("double").alias("y"))
        .orderBy(F.xxhash64("l_id"), "l_id", "y")
        .limit(most)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    return (
        with_statistics(rows)
        .select("row.doc_id", *[f"q_{k}" for k in STATISTICS], "row.y")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(most)
    )


def train(docs: DataFrame, labels: DataFrame) -> Ensemble:
    held = fit_rows(docs, labels).toPandas()
    held = held.sort_values(["doc_id", "y", *[f"q_{k}" for k in STATISTICS]], kind="stable")
    x = held[[f"q_{k}" for k in STATISTICS]].to_numpy(float)
    return fit(x, held["y"].to_numpy(float), STATISTICS)


def score_rows(docs: DataFrame, model: Ensemble) -> DataFrame:
    """``row`` (all columns of ``docs``, among them text) and score, by column expressions alone.
    A null text is scored as an empty one."""
    return with_statistics(docs).select("row", model.score().alias("score"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text; other columns
    are not looked at) by a model of ``labels`` (doc_id, quality).

    A null text is scored as an empty one. Rows that repeat are scored alike. A null id is held
    out. With no labelled rows all scores are one half; an empty table gives an empty result.
    Labels, language, source and ids are never inputs of a score.
    """
    doc_id = F.col("row.doc_id")
    return score_rows(docs.select("doc_id", "text"), train(docs, labels)).select(
        "row.doc_id",
        (fold_of(doc_id) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) whose score is at least the threshold.

    The row number keeps the optimizer from moving the filter below the statistics, where it would
    spell out each of them once for every rule that tests it.
    """
    rows = score_rows(docs, train(docs, labels)).withColumn("q_n", F.monotonically_increasing_id())
    return rows.filter((F.col("score") >= THRESHOLD) & (F.col("q_n") >= 0)).select("row.*")
