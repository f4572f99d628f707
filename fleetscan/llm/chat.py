"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered as a whole by a template that escapes control strings in texts; the
rendering is encoded once, with offsets; the sorted spans of assistant texts meet the sorted token
spans by binary search. The mask, and from it the texts, are read back from tokens.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, rows_to_batches, shuffle_partitions

TOKENIZER = "byte_bpe_50k.json"
#: Control strings of the template (fixed values).
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
#: Put behind the first character of a control string in a text, and doubled where it is there.
ESCAPE = "\\"
LEARNED_ROLE = "assistant"
#: A conversation longer than this is encoded in runs of whole turns.
RUN_CHARS = 1 << 22

_TO_ESCAPE = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(ESCAPE)}*{re.escape(c[1:])})" for c in CONTROLS))
_TO_RESTORE = re.compile(
    "|".join(f"{re.escape(c[0])}{re.escape(ESCAPE)}(?={re.escape(ESCAPE)}*{re.escape(c[1:])})" for c in CONTROLS)
)
_HEAD = re.compile(r"<s>(?:\[ROLE\](null|=(.*?))\[/ROLE\]|(\[INST\]))", re.S)


def escape(text: str) -> str:
    """The text with no control string in it: one that begins with a control's first character
    and goes on, behind any number of escapes, with its rest gets one escape more."""
    return _TO_ESCAPE.sub(lambda m: m[0] + ESCAPE, text)


def restore(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _TO_RESTORE.sub(lambda m: m[0][:-1], text)


def render_turn(role: str | None, text: str) -> tuple[str, str, str]:
    """What stands before the escaped text of a turn, the text, and what stands behind."""
    if role == "user":
        return "<s>[INST]", escape(text), "[/INST]</s>"
    named = "null" if role is None else "=" + escape(role)
    return f"<s>[ROLE]{named}[/ROLE]", escape(text), "</s>"


def parse(rendered: str) -> list[tuple[str | None, str, int, int]]:
    """The turns of a rendering, by its control strings alone: role, text, and where the escaped text
    starts and stops."""
    turns, at = [], 0
    while at < len(rendered):
        head = _HEAD.match(rendered, at)
        role = "user" if head[3] else None if head[1] == "null" else restore(head[2])
        stop = rendered.index("</s>", head.end())
        end = stop - len("[/INST]") if head[3] else stop
        turns.append((role, restore(rendered[head.end() : end]), head.end(), end))
        at = stop + len("</s>")
    return turns


class Encoder:
    """Ids and code point offsets by the byte-level tokenizer, white space included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, processors

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        return np.array(found.ids, dtype=np.int32), offsets


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def loss_mask(spans: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each token, whether it has a character of a span. Both are sorted and the spans don't
    overlap, so the only span that can meet a token is the last that starts before its end."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    last = np.searchsorted(spans[:, 0], offsets[:, 1], "left") - 1
    return (last >= 0) & (spans[np.maximum(last, 0), 1] > offsets[:, 0])


def masked_texts(rendered: str, spans: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The characters of each span that masked tokens cover, a token at a span's edge counting
    within the span only and characters of more than one token once."""
    held = offsets[mask]
    out = []
    for start, stop in spans:
        first = int(np.searchsorted(held[:, 1], start, "right"))
        last = int(np.searchsorted(held[:, 0], stop, "left"))
        parts, at = [], start
        for a, b in held[first:last]:
            a, b = max(a, at), min(b, stop)
            if b > a:
                parts.append(rendered[a:b])
                at = b
        out.append("".join(parts))
    return out


def learned_spans(spans: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The spans all of whose tokens are masked: a token that reaches over the edge of a masked span
    may touch the next, whose other tokens are not."""
    if not len(offsets):
        return spans[:0]
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    total = np.r_[0, np.cumsum(mask)]
    filled = (spans[:, 1] > spans[:, 0]) & (last > first)
    return spans[filled & (total[last] - total[first] == last - first)]


@dataclass
class Formatted:
    """One run of a conversation: its rendering, tokens, offsets and mask."""

    rendered: str
    ids: np.ndarray
    offsets: np.ndarray
    mask: np.ndarray


def format_run(turns: list[tuple[str | None, str]], encoder: Encoder) -> Formatted:
    parts, spans, at = [], [], 0
    for role, text in turns:
        before, body, behind = render_turn(role, text)
        if role == LEARNED_ROLE:
            spans.append((at + len(before), at + len(before) + len(body)))
        parts += (before, body, behind)
        at += len(before) + len(body) + len(behind)
    rendered = "".join(parts)
    ids, offsets = encoder.encode(rendered)
    edges = np.array(spans, dtype=np.int64).reshape(-1, 2)
    return Formatted(rendered, ids, offsets, loss_mask(edges, offsets))


@dataclass
class Digest:
    """What is read back from the formatted runs of a conversation."""

    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, run: Formatted) -> None:
        """Take up a run, by what its output holds: where turns lie is parsed from the rendering, and
        which text is learned follows from mask and offsets."""
        spans = []
        for role, text, start, stop in parse(run.rendered):
            self.n_turns += 1
            self.turns.update(f"{role or ''}\n{text}\n".encode("utf-8", "surrogatepass"))
            spans.append((start, stop))
        edges = np.array(spans, dtype=np.int64).reshape(-1, 2)
        for text in masked_texts(run.rendered, learned_spans(edges, run.offsets, run.mask), run.offsets, run.mask):
            plain = restore(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.formatted_chars += len(run.rendered)


def runs(turns: Iterable[tuple[str | None, str]], encoder: Encoder) -> Iterator[Formatted]:
    """The turns of one conversation as they come, formatted in one run if they fit."""
    held, size = [], 0
    for turn in turns:
        held.append(turn)
        size += len(turn[1])
        if size >= RUN_CHARS:
            yield format_run(held, encoder)
            held, size = [], 0
    if held:
        yield format_run(held, encoder)


FORMATTED = (
    "conv_id long, run long, rendered string, ids array<int>, starts array<long>, "
    "stops array<long>, mask array<boolean>"
)
FORMATTED_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("run", pa.int64()),
        ("rendered", pa.string()),
        ("ids", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int64())),
        ("stops", pa.list_(pa.int64())),
        ("mask", pa.list_(pa.bool_())),
    ]
)
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)
DIGEST_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order; null turns come last, ties by role and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = shuffle_partitions(conversations.sparkSession)
    return (
        conversations.select("conv_id", "turn", "role", text.alias("text"))
        .repartition(n, "conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    )


def _by_conversation(batches) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Conversations one after the other, each as a stream of (role, text)."""
    rows = (
        row
        for batch in batches
        for row in zip(*(column(batch, n) for n in ("conv_id", "role", "text")))
    )
    ahead = next(rows, None)
    while ahead is not None:
        now = ahead[0]

        def own():
            nonlocal ahead
            while ahead is not None and ahead[0] == now:
                yield ahead[1], ahead[2]
                ahead = next(rows, None)

        yield now, own()


def formatted(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Renderings, token ids, offsets and masks, a row for each conversation (several runs of whole
    turns for a very long one).

    ``conversations`` has conv_id, turn, role and text; other columns are not looked at. A null text
    is empty; a null role is a role of its own; rows with a null conv_id are one conversation. Rows
    that repeat are turns of their own. An empty table gives an empty result.
    """

    def run(batches):
        encoder = Encoder(tokenizer or default_tokenizer())

        def rows():
            for conv, turns in _by_conversation(batches):
                for k, one in enumerate(runs(turns, encoder)):
                    yield 30 * len(one.ids), (
                        conv, k, one.rendered, one.ids, one.offsets[:, 0], one.offsets[:, 1], one.mask)

        yield from rows_to_batches(rows(), FORMATTED_ARROW)

    return _ordered(conversations).mapInArrow(run, FORMATTED)


def digests(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """What is read back from the formatted conversations, one row for each; see
    :func:`formatted` for odd rows. A task holds one run of one conversation at a time."""

    def run(batches):
        encoder = Encoder(tokenizer or default_tokenizer())

        def rows():
            for conv, turns in _by_conversation(batches):
                seen = Digest()
                for one in runs(turns, encoder):
                    seen.add(one)
                yield 0, (
                    conv,
                    seen.n_turns,
                    seen.turns.hexdigest(),
                    seen.loss_chars,
                    seen.loss.hexdigest(),
                    seen.formatted_chars,
                )

        yield from rows_to_batches(rows(), DIGEST_ARROW)

    return _ordered(conversations).mapInArrow(run, DIGEST)
