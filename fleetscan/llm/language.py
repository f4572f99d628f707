"""Language of whole texts, and of the spans in mixed ones.

A word is a run of letters. Its script leaves only the languages that are written in it; hashed
letter trigrams score these. The Viterbi path through a text's words, with a penalty for
each switch, labels spans; the language with the most letters is the text's.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fold_of, summed_arrays

BUCKETS = 1 << 15
SWITCH = 12.0
#: A language is a candidate for a script that has this share of its letters.
SCRIPT_SHARE = 0.005
NOT_A_CANDIDATE = -40.0
SMOOTHING = 0.5
UNKNOWN = "und"
#: Words held at once: their scores go through the Viterbi steps together.
HELD_WORDS = 200_000

#: First code points of scripts (fixed values, from the Unicode block table). A script reaches to
#: the next entry.
SCRIPT_STARTS = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0700, "Other"),
    (0x0750, "Arabic"),
    (0x0780, "Other"),
    (0x08A0, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"),
    (0x0B80, "Tamil"),
    (0x0C00, "Telugu"),
    (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"),
    (0x0E00, "Thai"),
    (0x0E80, "Lao"),
    (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x13A0, "Other"),
    (0x1780, "Khmer"),
    (0x1800, "Mongolian"),
    (0x18B0, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x3040, "Hiragana"),
    (0x30A0, "Katakana"),
    (0x3100, "Other"),
    (0x3130, "Hangul"),
    (0x3190, "Other"),
    (0x3400, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"),
    (0xFE00, "Other"),
    (0xFE70, "Arabic"),
    (0xFF00, "Latin"),
    (0xFF66, "Katakana"),
    (0xFFA0, "Hangul"),
    (0xFFE0, "Other"),
    (0x20000, "Han"),
    (0x32000, "Other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 for letters and 2 for marks inside words; lower case; script."""
    n = sys.maxunicode + 1
    kind, lower = np.zeros(n, np.uint8), np.arange(n, dtype=np.uint32)
    for c in range(0x32000):
        group = unicodedata.category(chr(c))[0]
        if group in "LM":
            kind[c] = 1 if group == "L" else 2
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
    script = np.zeros(n, np.uint8)
    for start, name in SCRIPT_STARTS:
        script[start:] = SCRIPTS.index(name)
    return kind, lower, script


@dataclass
class Words:
    """The words of a text: place of the first letter, number of letters, script, and for each
    letter the bucket of the trigram around it."""

    starts: np.ndarray
    lengths: np.ndarray
    scripts: np.ndarray
    buckets: np.ndarray


def words_of(text: str | None) -> Words | None:
    """None if the text is null or has no letter."""
    if not text:
        return None
    kinds, lower, script = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds[codes]
    if not (kind == 1).any():
        return None
    inside = np.concatenate(([False], kind > 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edge[::2], edge[1::2]
    small = np.concatenate(([0], np.where(kind > 0, lower[codes], 0), [0])).astype(np.int64)
    hashed = small[:-2] * 961_748_941 + small[1:-1] * 32_452_843 + small[2:] * 15_485_863
    hashed = ((hashed ^ (hashed >> 17)) * 0x9E3779B1 >> 11) & (BUCKETS - 1)
    return Words(
        starts.astype(np.int32),
        (stops - starts).astype(np.int32),
        script[codes[starts]],
        hashed[kind > 0].astype(np.uint16),
    )


@dataclass
class Model:
    """Log-probabilities of trigram buckets by language, and the languages of each script."""

    languages: list[str]
    table: np.ndarray
    candidates: np.ndarray
    prior: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Words by languages, with a maximum of 0 for each word."""
        ends = np.cumsum(words.lengths, dtype=np.int64)
        each = np.add.reduceat(self.table[words.buckets], ends - words.lengths, axis=0)
        allowed = self.candidates[words.scripts]
        each = np.where(allowed, each, -np.inf)
        top = each.max(axis=1, keepdims=True)
        return np.where(allowed, np.maximum(each - top, NOT_A_CANDIDATE), NOT_A_CANDIDATE)


def learn(docs: DataFrame) -> Model:
    """A model from text and lang of ``docs``, over all of their letters. Rows with a null text or
    lang teach nothing. What comes to the driver is one table for each language."""

    def count(batches):
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for text, lang in zip(column(batch, "text"), column(batch, "lang")):
                if (words := words_of(text)) is None:
                    continue
                if lang not in seen:
                    seen[lang] = (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64))
                grams, scripts = seen[lang]
                grams += np.bincount(words.buckets, minlength=BUCKETS)
                scripts += np.bincount(
                    words.scripts, words.lengths, minlength=len(SCRIPTS)
                ).astype(np.int64)
        for lang, (grams, scripts) in seen.items():
            keys = [f"g{lang}", f"s{lang}"]
            yield pa.RecordBatch.from_pydict(
                {"key": keys, "data": [grams.tobytes(), scripts.tobytes()]}
            )

    rows = docs.filter("text is not null and lang is not null").select("text", "lang")
    parts = rows.mapInArrow(count, "key string, data binary")
    sums = {r["key"]: np.frombuffer(r["data"], np.int64) for r in summed_arrays(parts, "int64").collect()}
    languages = sorted(k[1:] for k in sums if k[0] == "g")
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool), np.zeros(0))
    grams = np.stack([sums[f"g{x}"] for x in languages], axis=1).astype(float)
    scripts = np.stack([sums[f"s{x}"] for x in languages], axis=1).astype(float)
    table = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS))
    candidates = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=0), 1)
    candidates[~candidates.any(axis=1)] = True
    return Model(languages, table.astype(np.float32), candidates, grams.sum(axis=0))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row of ``scores`` (words by labels) for texts of ``lengths`` words,
    one after the other: the most score, less ``switch`` for each change of label. All texts
    go step by step together; ties stay with the label at hand, then take the first."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    counts = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
    stay = np.zeros(scores.shape, bool)
    top = np.zeros(len(scores), np.int16)
    held = np.zeros((len(lengths), scores.shape[1]), np.float32)
    for step, n in enumerate(counts):
        at, d = first[:n] + step, held[:n]
        # d is relative to the best path so far, which a switch comes from
        stay[at] = d >= -switch
        np.maximum(d, -switch, out=d)
        d += scores[at]
        best = d.argmax(axis=1)
        top[at] = best
        d -= d[np.arange(n), best][:, None]
    labels = np.zeros(len(scores), np.int16)
    now = np.zeros(len(lengths), np.int16)
    for step in range(len(counts) - 1, -1, -1):
        n = counts[step]
        at = first[:n] + step
        ends = lengths[order[:n]] == step + 1
        label = np.where(ends, top[at], now[:n])
        labels[at] = label
        if step:
            now[:n] = np.where(stay[at, label], label, top[at - 1])
    return labels


SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())])
RESULT = "lang_pred string, score double, spans array<struct<start:long,stop:long,lang:string>>"


def _label(model: Model, held: list[Words | None]) -> list[tuple]:
    """(lang_pred, score, spans) for several texts."""
    some = [w for w in held if w is not None]
    if not some:
        return [(UNKNOWN, 0.0, [])] * len(held)
    labels = viterbi(
        np.concatenate([model.scores(w) for w in some]), np.array([len(w.starts) for w in some])
    )
    out, at = [], 0
    for words in held:
        if words is None:
            out.append((UNKNOWN, 0.0, []))
            continue
        n = len(words.starts)
        own = labels[at : at + n]
        at += n
        letters = np.bincount(own, words.lengths, minlength=len(model.languages))
        best = int(np.lexsort((model.prior, letters))[-1])
        change = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [n]))
        spans = [
            {
                "start": int(words.starts[a]),
                "stop": int(words.starts[b - 1] + words.lengths[b - 1]),
                "lang": model.languages[own[a]],
            }
            for a, b in zip(change[:-1], change[1:])
        ]
        out.append((model.languages[best], float(letters[best] / letters.sum()), spans))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (all columns of ``docs``, among them text), lang_pred, score (the share of letters
    in spans of lang_pred) and spans (code point offsets), for every row of ``docs``.

    A text that is null, empty or without letters is ``und`` with score 0 and no spans, and so is
    every text under a model that has learned no language. Rows that repeat get equal results. A
    script of no learned language leaves all of them as candidates. The other columns go along as
    they are, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        model = shared.value
        for batch in batches:
            rows = batch.column(0)
            texts = rows.field("text")
            start, held, n = 0, [], 0
            for k, text in enumerate(texts):
                words = words_of(text.as_py()) if model.languages else None
                held.append(words)
                n += len(words.starts) if words else 0
                if n >= HELD_WORDS or k == len(texts) - 1:
                    yield _labelled(model, rows.slice(start, len(held)), held)
                    start, held, n = k + 1, [], 0

    rows = docs.select(F.struct("*").alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(label, f"row {kind}, {RESULT}")


def _labelled(model: Model, rows: pa.Array, held: list[Words | None]) -> pa.RecordBatch:
    languages, scores, spans = zip(*_label(model, held))
    return pa.RecordBatch.from_arrays(
        [
            rows,
            pa.array(languages, pa.string()),
            pa.array(scores, pa.float64()),
            pa.array(spans, pa.list_(SPAN)),
        ],
        ["row", "lang_pred", "score", "spans"],
    )


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans, the model being learned from the documents of
    ``docs`` (doc_id, text, lang) that are not held out. A null id is held out."""
    model = learn(docs.filter(fold_of(F.col("doc_id")) != 0))
    return identify(docs.select("doc_id", "text"), model).select(
        "row.doc_id",
        (fold_of(F.col("row.doc_id")) == 0).alias("held_out"),
        "lang_pred",
        "score",
        "spans",
    )


#: A text is kept if this share of its letters is in spans of one language.
KEPT_SHARE = 0.3


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others) with a language: those that are not
    ``und`` and have at least ``KEPT_SHARE`` of their letters in one language. The model is learned as
    in :func:`predicted`."""
    model = learn(docs.filter(fold_of(F.col("doc_id")) != 0))
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= KEPT_SHARE)
    return identify(docs, model).filter(good).select("row.*")
