"""Keys that make repeated failures comparable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import (
    blank, contains_ci, first_nonblank, hex_sha256, nonblank, norm, strip, text,
)

GUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
# Replacements for the summary key, in order.
SUMMARY_REPLACEMENTS = [
    (
        r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}(?:[ T]\d{1,2}[:.]\d{2}[:.]\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?\b",
        "{TIMESTAMP}",
    ),
    (GUID, "{GUID}"),
    (r"\[(?:\d+)\]", "{ID}"),
    (r"(?i):line\s+\d+", ":line {LINE}"),
    (r"\b\d{5,}\b", "{NUMBER}"),
    (r"\s+", " "),
]
# Replacements for the incident key, in order.
MESSAGE_REPLACEMENTS = [
    (
        r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}[ T]\d{1,2}[:.]\d{2}[:.]\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\b",
        "{TIMESTAMP}",
    ),
    (GUID, "{GUID}"),
    (r"\b(?=[0-9A-Fa-f]{10,}\b)(?=.*[A-Fa-f])[0-9A-Fa-f]+\b", "{HEX}"),
    (r"(?i):line\s+\d+", ":line {LINE}"),
    (r"\b\d+\b", "{NUMBER}"),
    (r"\s+", " "),
]
# Replacements for the path part of the incident key, in order.
PATH_REPLACEMENTS = [
    (r"\?.*$", ""),
    (GUID, "{GUID}"),
    (r"/\d{4,}(?=/|$)", "/{ID}"),
    (r"/{2,}", "/"),
]


def replace_all(c: Column, steps) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def error_signature(
    exception: Column, status: Column, path: Column, raw: Column, message: Column
) -> Column:
    """Summary key. Exception and path keep their case."""
    body = F.when(blank(raw), text(message)).otherwise(raw)
    return F.concat_ws(
        "|",
        text(exception),
        text(status),
        text(path),
        strip(F.lower(replace_all(body, SUMMARY_REPLACEMENTS))),
    )


def normalize_message(message: Column) -> Column:
    return F.when(
        nonblank(message), F.lower(strip(replace_all(message, MESSAGE_REPLACEMENTS)))
    ).otherwise("")


def normalize_path(path: Column) -> Column:
    cleaned = strip(replace_all(path, PATH_REPLACEMENTS))
    return F.when(nonblank(path), F.lower(F.regexp_replace(cleaned, "/+$", ""))).otherwise("")


def normalize_server(server: Column) -> Column:
    return F.upper(F.split_part(strip(text(server)), F.lit("."), F.lit(1)))


def incident_title(
    message: Column, exception: Column, status: Column, path: Column, severity: Column
) -> Column:
    live = contains_ci(text(message), "signalr") & contains_ci(text(message), "disconnected")
    return (
        F.when(live, "SignalR connection failure")
        .when(nonblank(exception), exception)
        .when(status.isNotNull(), F.concat(F.lit("HTTP "), status.cast("string")))
        .when(nonblank(path), F.concat(path, F.lit(" failure")))
        .otherwise(F.concat(text(severity), F.lit(" application incident")))
    )


def incident_key_text(
    message: Column, exception: Column, status: Column, path: Column, server: Column,
    machine: Column, environment: Column, severity: Column,
) -> Column:
    return F.concat_ws(
        "|",
        norm(incident_title(message, exception, status, path, severity)),
        norm(exception),
        text(status),
        normalize_path(path),
        normalize_server(first_nonblank(server, machine)),
        norm(environment),
        normalize_message(message),
    )


def incident_signature(*fields: Column) -> Column:
    return hex_sha256(incident_key_text(*fields))


def correlation_group(
    correlation_id: Column, path: Column, server: Column, machine: Column,
    environment: Column, exception: Column, status: Column,
) -> Column:
    """The correlation id itself, or 12 hex digits over the other fields."""
    parts = F.concat_ws(
        "|", text(path), first_nonblank(server, machine), text(environment), text(exception),
        text(status),
    )
    return (
        F.when(nonblank(correlation_id), correlation_id)
        .when(blank(F.replace(parts, F.lit("|"), F.lit(""))), "")
        .otherwise(F.substring(hex_sha256(parts), 1, 12))
    )


def evidence_signature(exception: Column, status: Column, path: Column, message: Column) -> Column:
    return F.concat_ws("|", norm(exception), text(status), norm(path), norm(message))
