"""Building expressions once.

A column expression refers to columns by name and to no data, so it serves every plan of a
JVM. Building one costs a round trip to the JVM per operator, which for the fused rule
projection is thousands.
"""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext

_LIMIT = 512


def once(build):
    """Keep what ``build(*args)`` returns, per JVM and arguments. Arguments must be hashable."""
    kept: dict = {}

    @wraps(build)
    def call(*args):
        key = (SparkContext._gateway, *args)
        if key not in kept:
            if len(kept) >= _LIMIT:
                kept.clear()
            kept[key] = build(*args)
        return kept[key]

    return call
