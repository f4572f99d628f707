"""Path predicates. Paths are relative to the project root and use forward slashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscan import values as V
from fleetscan.functions.text import any_of, contains_any


def normalise(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("int")


def has_extension(path: Column, extensions) -> Column:
    """True when the path ends in one of the extensions, dot included."""
    return any_of(path.endswith(e) for e in extensions)


def scannable(path: Column) -> Column:
    """A known file name, or a known extension; a bare dotfile has no extension."""
    endings = "|".join(re.escape(e) for e in V.SCANNABLE_EXTENSIONS)
    return basename(path).isin(V.SCANNABLE_NAMES) | path.rlike(rf"[^/](?:{endings})\z")


def excluded(path: Column, ignore_case: bool = True) -> Column:
    """Below one of the directories that are never scanned."""
    names = "|".join(re.escape(d) for d in V.EXCLUDED_DIRS)
    flag = "(?i)" if ignore_case else ""
    return path.rlike(rf"{flag}(?:^|/)(?:{names})/")


def is_code(path: Column) -> Column:
    return has_extension(path, V.CODE_EXTENSIONS)


def is_test_file(path: Column) -> Column:
    name = basename(path)
    in_test_dir = path.startswith("__tests__/") | path.contains("/__tests__/")
    return in_test_dir | (name == "__tests__") | name.contains(".test.") | name.contains(".spec.")


def is_app_code(path: Column) -> Column:
    """Code including ES and CommonJS modules, tests left out."""
    return has_extension(path, V.MODULE_EXTENSIONS) & ~is_test_file(path)


def is_api_route(path: Column) -> Column:
    return path.contains("/api/") | path.startswith("api/")


def is_risky_route(path: Column) -> Column:
    return contains_any(path, V.RISKY_ROUTES)


def is_admin_route(path: Column) -> Column:
    return contains_any(path, V.ADMIN_ROUTES)


def is_manifest(path: Column) -> Column:
    return (path == "package.json") | path.endswith("/package.json")
