"""Text functions over columns. Built-in expressions only, so they stay in codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscan.values import TRIM_CHARS


def any_of(predicates) -> Column:
    """OR of the predicates; false when there are none."""
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def contains_any(col: Column, words) -> Column:
    """Case-sensitive: does ``col`` hold one of the words anywhere."""
    return any_of(col.contains(w) for w in words)


def split_lines(content: Column) -> Column:
    """Lines of a text, cut at line feeds only; a final line feed gives one empty line more."""
    return F.split(content, "\n", -1)


def line_count(content: Column) -> Column:
    """``size(split_lines(content))`` without building the array."""
    without = F.replace(content, F.lit("\n"), F.lit(""))
    return (F.octet_length(content) - F.octet_length(without) + 1).cast("int")


def strip(col: Column) -> Column:
    """Trim all white space (Spark's ``trim`` takes blanks only)."""
    return F.btrim(col, F.lit(TRIM_CHARS))


def clip(col: Column, n: int = 100) -> Column:
    """Trimmed text, cut to ``n`` characters for one-line display."""
    return F.substring(strip(col), 1, n)


def first_match(col: Column, pattern: str) -> Column:
    """The leftmost match, or an empty text."""
    return F.regexp_extract(col, pattern, 0)


def count_word(content: Column, word: str) -> Column:
    """How often ``word`` stands alone, letters, digits and underscore being word characters.

    ASCII classes on purpose: the boundary must not see accented letters as word
    characters. The literal comes first so that the matcher skips along it.
    """
    w = "[A-Za-z0-9_]"
    pattern = f"{word}(?<!{w}{word})(?!{w})"
    return F.when(content.contains(word), F.regexp_count(content, F.lit(pattern))).otherwise(0)


def redact(secret: Column) -> Column:
    """Mask a secret for display; longer ones keep four characters at each end."""
    n = F.length(secret)
    return (
        F.when(n == 0, secret)
        .when(n <= 4, F.lit("***"))
        .when(n <= 8, F.concat(F.substring(secret, 1, 2), F.lit("***"), F.right(secret, F.lit(1))))
        .otherwise(F.concat(F.substring(secret, 1, 4), F.lit("..."), F.right(secret, F.lit(4))))
    )


def fill(template: Column, detail: Column) -> Column:
    """Put ``detail`` into a catalogue text holding ``{detail}``."""
    return F.replace(template, F.lit("{detail}"), F.coalesce(detail, F.lit("")))
