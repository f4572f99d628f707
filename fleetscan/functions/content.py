"""Whole-content markers. All are case-sensitive substring tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscan import values as V
from fleetscan.functions.text import any_of, contains_any


def is_client(path: Column, content: Column) -> Column:
    """Shipped to the browser: a client directive, or below ``pages/`` but not its API part."""
    page = path.startswith("pages/") & ~path.startswith("pages/api/")
    return page | contains_any(content, V.CLIENT_DIRECTIVES)


def is_server(path: Column, content: Column) -> Column:
    route = path.startswith("app/api/") | path.startswith("pages/api/")
    return route | contains_any(content, V.SERVER_DIRECTIVES)


def file_side(path: Column, content: Column) -> Column:
    """``client``, ``server``, ``both`` or ``neutral``."""
    client, server = is_client(path, content), is_server(path, content)
    return (
        F.when(client & server, "both")
        .when(client, "client")
        .when(server, "server")
        .otherwise("neutral")
    )


def has_mutating_handler(content: Column) -> Column:
    """Exports a handler for a mutating method, or compares the request method with one."""
    exported = any_of(
        content.contains(f"export {kind} {m}")
        for m in V.MUTATING_METHODS
        for kind in ("async function", "function")
    )
    quoted = any_of(content.contains(f"{q}{m}{q}") for m in V.MUTATING_METHODS for q in "\"'")
    return exported | (content.contains("req.method") & quoted)


def has_auth(content: Column) -> Column:
    return contains_any(content, V.AUTH_MARKERS)


def has_authorization(content: Column) -> Column:
    return contains_any(content, V.AUTHZ_MARKERS)


def reads_body(content: Column) -> Column:
    return contains_any(content, V.BODY_READS)


def has_validation(content: Column) -> Column:
    return contains_any(content, V.VALIDATION_LIBRARIES + V.VALIDATION_CALLS)
