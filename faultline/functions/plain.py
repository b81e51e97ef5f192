"""Field extraction from plain-text log events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import contains_ci, extract, first_nonblank, lines_of, nonblank, strip

# Patterns that decide what counts as an event, a level, a field.
TIMESTAMP_AT_START = (
    r"^\s*[\[\(]?\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?"
)
LEVEL_AT_START = r"(?i)^\s*(?:CRITICAL|FATAL|ERROR|ERR|WARNING|WARN|INFO|DEBUG|TRACE)\b"
EXCEPTION = r"\b(?:[A-Za-z_][A-Za-z0-9_.+`]*Exception)\b"
STATUS_AFTER_HTTP = r"(?i)\bHTTP(?:/\d(?:\.\d)?)?\s+(?:status\s*)?([45]\d{2})\b"
STATUS_NAMED = r"(?i)\b(?:status|statusCode|httpStatusCode)\s*[:=]\s*([45]\d{2})\b"
STATUS_WITH_REASON = (
    r"(?i)\b([45]\d{2})\s+(?:Bad Request|Unauthorized|Forbidden|Not Found|Request Timeout"
    r"|Conflict|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout)\b"
)
LEVEL_CRITICAL = r"(?i)\b(?:CRITICAL|FATAL)\b"
LEVEL_ERROR = r"(?i)\b(?:ERROR|ERR)\b"
LEVEL_WARNING = r"(?i)\b(?:WARNING|WARN)\b"
URL = r"""https?://[^\s"']+"""
URL_TRAILING = r"""[.,:;)\]}"']+$"""
TIMESTAMP = (
    r"\b\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\b"
)
CORRELATION_ID = (
    r"(?i)\b(?:correlation[-_ ]?id|request[-_ ]?id|trace[-_ ]?id)\s*[:=]\s*([A-Za-z0-9\-]+)"
)
SERVER_NAME = r"(?i)\b(?:server|serverName)\s*[:=]\s*([A-Za-z0-9._\-]+)"
MACHINE_NAME = r"(?i)\b(?:machine|machineName|host|hostName)\s*[:=]\s*([A-Za-z0-9._\-]+)"
ENVIRONMENT = (
    r"(?i)\b(?:environment|env)\s*[:=]\s*(DEV|RQA\d*|QA|UAT|PREPROD|PROD|PRODUCTION)\b"
)
USER_NAME = r"(?i)\b(?:user|userName|loginName)\s*[:=]\s*([A-Za-z0-9._@\\\-]+)"
# Server name fragments that reveal the environment, first match wins.
ENVIRONMENT_BY_HOST = [
    ("PREPROD", "PREPROD"),
    ("RQA", "RQA"),
    ("UAT", "UAT"),
    ("DEV", "DEV"),
    ("PROD", "PROD"),
    ("PRIV", "PROD"),
]
URL_PATH = r"(?i)^https?://[^/?#]+([^?#]*)"
URL_SHAPE = r"(?i)^https?://[A-Za-z0-9._~%@\-\[\]]+(?::\d*)?(?:[/?#]|$)"


def starts_event(line: Column) -> Column:
    return line.rlike(TIMESTAMP_AT_START) | line.rlike(LEVEL_AT_START)


def exception_type(content: Column) -> Column:
    return extract(content, EXCEPTION, 0)


def http_status(content: Column) -> Column:
    found = [
        F.nullif(extract(content, p), F.lit(""))
        for p in (STATUS_AFTER_HTTP, STATUS_NAMED, STATUS_WITH_REASON)
    ]
    return F.coalesce(*found).cast("int")


def severity(primary: Column, content: Column, status: Column, exception: Column) -> Column:
    failed = F.coalesce(status >= 400, F.lit(False)) | nonblank(exception)
    return (
        F.when(primary.rlike(LEVEL_CRITICAL), "Critical")
        .when(primary.rlike(LEVEL_ERROR) | failed, "Error")
        .when(primary.rlike(LEVEL_WARNING), "Warning")
        .when(content.rlike(LEVEL_CRITICAL), "Critical")
        .when(content.rlike(LEVEL_WARNING), "Warning")
        .otherwise("Information")
    )


def request_url(content: Column) -> Column:
    return F.regexp_replace(extract(content, URL, 0), URL_TRAILING, "")


def api_path(url: Column) -> Column:
    """Path of an absolute URL; a bare host is ``/``; anything else is ``""``."""
    path = extract(url, URL_PATH)
    return F.when(
        url.rlike(URL_SHAPE), F.when(path == "", F.lit("/")).otherwise(path)
    ).otherwise("")


def correlation_id(content: Column) -> Column:
    return extract(content, CORRELATION_ID)


def server_name(content: Column) -> Column:
    return extract(content, SERVER_NAME)


def machine_name(content: Column) -> Column:
    return first_nonblank(extract(content, MACHINE_NAME), server_name(content))


def environment_of_host(host: Column) -> Column:
    chain = None
    for fragment, env in ENVIRONMENT_BY_HOST:
        hit = contains_ci(host, fragment)
        chain = F.when(hit, env) if chain is None else chain.when(hit, env)
    return chain.otherwise("")


def environment(explicit: Column, server: Column, machine: Column) -> Column:
    """Named environment, otherwise the one the server (or machine) name reveals."""
    named = F.upper(explicit)
    return F.when(
        named != "", F.when(named == "PRODUCTION", F.lit("PROD")).otherwise(named)
    ).otherwise(environment_of_host(first_nonblank(server, machine)))


def user_name(content: Column) -> Column:
    return extract(content, USER_NAME)


def timestamp(primary: Column) -> Column:
    """First ISO-like stamp of the primary line; a missing zone means UTC."""
    stamp = F.regexp_replace(extract(primary, TIMESTAMP, 0), "/", "-")
    return F.nullif(stamp, F.lit("")).try_cast("timestamp")


def display_message(primary: Column, content: Column) -> Column:
    first_line = F.try_element_at(F.filter(lines_of(content), lambda x: x != ""), F.lit(1))
    return F.when(nonblank(primary), strip(primary)).otherwise(
        F.coalesce(strip(first_line), F.lit(""))
    )


def stack_trace(content: Column) -> Column:
    """All non-blank lines after the first."""
    lines = lines_of(content)
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.array_join(F.filter(rest, lambda x: x.rlike(r"\S")), "\n")


def is_relevant(severity_: Column, exception: Column, status: Column) -> Column:
    return (
        severity_.isin("Error", "Critical", "Warning")
        | nonblank(exception)
        | F.coalesce(status >= 400, F.lit(False))
    )
