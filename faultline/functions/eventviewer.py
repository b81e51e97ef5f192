"""Field extraction from Event Viewer text exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.plain import EXCEPTION, api_path as plain_path, environment_of_host
from faultline.functions.text import (
    any_of, contains_ci, extract, first_nonblank, nonblank, strip,
)

# Words of a header line, recognised levels, stamp formats.
HEADER_WORDS = ["Level", "Date and Time", "Source", "Event ID", "Task Category"]
LEVELS = ["Critical", "Error", "Warning", "Information", "Verbose", "Audit Success", "Audit Failure"]
STAMP_FORMATS = [
    "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "d.M.yyyy H.mm.ss", "d.M.yyyy H:mm:ss",
    "M/d/yyyy h:mm a", "M/d/yyyy H:mm", "M/d/yyyy",
]
# Further forms of the same culture, after an optional day of the week.
LOOSE_STAMPS = [f"{date}[ h:mm[:ss] a][ H:mm[:ss]]" for date in ("M/d/yy", "M-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")]
WEEKDAY = r"(?i)^(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?,?\s+"
# Field patterns.
EXPLICIT_TYPE = r"(?im)^\s*Error Type\s*:\s*([A-Za-z_][A-Za-z0-9_.+`]*Exception)\s*$"
EXPLICIT_STATUS = r"(?im)^\s*Error Status Code\s*:\s*(\d{1,3})\s*$"
JSON_STATUS = r'(?i)"status"\s*:\s*([45]\d{2})'
FAILURE_STATUS = r"(?i)Http failure response.+?:\s*([45]\d{2})\b"
EXPLICIT_URL = r"(?im)^\s*Error Request Url\s*:\s*(https?://\S+)\s*$"
JSON_URL = r'(?i)"url"\s*:\s*"(https?://[^"]+)"'
ANY_URL = r"""(?i)https?://[^\s"']+"""
SERVER_NAME = r"(?im)^\s*(?:Host Name|Server Name|Server)\s*:\s*([A-Za-z0-9._\-]+)\s*$"
MACHINE_NAME = r"(?im)^\s*(?:Machine Name|Machine|Computer)\s*:\s*([A-Za-z0-9._\-]+)\s*$"
ENVIRONMENT = r"(?im)^\s*(?:Environment|Env)\s*:\s*(DEV|QA|RQA\d*|UAT|PREPROD|PROD|PRODUCTION)\s*$"
USER_NAME = (
    r"(?im)^\s*(?:User Name|Username|User|Login Name|LoginName)\s*:\s*([A-Za-z0-9._@\\\-]+)\s*$"
)
CORRELATION_ID = (
    r"(?im)^\s*(?:Correlation[-_ ]?Id|Request[-_ ]?Id|Trace[-_ ]?Id)\s*:\s*([A-Za-z0-9\-]+)\s*$"
)
URL_EDGE = r"""["'.,:;)\]}]+"""
GATEWAY = "/vsgateway/"
# Wrapper exceptions that are not preferred; diagnostic prefixes; line prefixes.
WRAPPERS = ["system.web.httpunhandledexception", "system.data.entity.core.entitycommandexecutionexception"]
DIAGNOSTIC_PREFIXES = ["outputValue.Value", "isSkipReviewEnabled:"]
METADATA_MARKERS = ["Date and Time:", "Host Name:", "Error Type:", "Error Details:"]
METADATA_PREFIXES = [
    "Date and Time:", "Host Name:", "Error Type:", "Error Source:", "Error Status Code:",
    "Error Request Url:", "Error Details:",
]
DEFAULT_MESSAGE = "Windows Event Viewer event"
MESSAGE_LIMIT = 600


def is_header(line: Column) -> Column:
    hit = nonblank(line)
    for word in HEADER_WORDS:
        hit = hit & contains_ci(line, word)
    return hit


def parse_stamp(text: Column) -> Column:
    """Known formats first, then ISO, then the looser forms; without a zone the session zone (UTC) counts."""
    t = strip(text)
    plain = F.regexp_replace(F.regexp_replace(t, WEEKDAY, ""), r"\s+(?:GMT|Z)$", "")
    dated = plain.rlike(r"^(?:\d{1,2}[/-]\d|[A-Za-z]{3,9} \d|\d{1,2} [A-Za-z])")
    return F.coalesce(
        *[F.try_to_timestamp(t, F.lit(f)) for f in STAMP_FORMATS],
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), t.try_cast("timestamp")),
        F.when(dated, F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in LOOSE_STAMPS])),
    )


def is_known_level(level: Column) -> Column:
    return F.lower(strip(level)).isin([x.lower() for x in LEVELS])


def record_fields(line: Column) -> Column:
    """Struct of the tab fields, null when the line does not start a record."""
    parts = F.split(line, "\t")
    stamp = parse_stamp(parts[1])
    fields = F.struct(
        strip(parts[0]).alias("level"),
        stamp.alias("ts"),
        strip(parts[2]).alias("event_source"),
        F.coalesce(strip(parts[3]).try_cast("int"), F.lit(0)).alias("event_id"),
        strip(parts[4]).alias("task_category"),
        strip(F.array_join(F.slice(parts, F.lit(6), F.greatest(F.size(parts), F.lit(1))), "\t")).alias("first_text"),
    )
    return F.when(
        (F.size(parts) >= 5) & is_known_level(parts[0]), F.when(stamp.isNotNull(), fields))


def unwrap_quotes(text: Column) -> Column:
    t = strip(text)
    return F.when(t.rlike(r'(?s)^".*"$'), F.regexp_extract(t, r'(?s)^"(.*)"$', 1)).otherwise(t)


def clean_description(text: Column) -> Column:
    return strip(F.replace(unwrap_quotes(text), F.lit('""'), F.lit('"')))


def exception_type(text: Column) -> Column:
    all_types = F.regexp_extract_all(text, F.lit(EXCEPTION), F.lit(0))
    preferred = F.filter(all_types, lambda x: ~F.lower(x).isin(WRAPPERS))
    return F.coalesce(
        F.nullif(extract(text, EXPLICIT_TYPE), F.lit("")),
        F.try_element_at(preferred, F.lit(1)),
        F.try_element_at(all_types, F.lit(1)),
        F.lit(""),
    )


def http_status(text: Column) -> Column:
    explicit = extract(text, EXPLICIT_STATUS).try_cast("int")
    return F.coalesce(
        F.when(explicit.between(100, 599), explicit),
        extract(text, JSON_STATUS).try_cast("int"),
        extract(text, FAILURE_STATUS).try_cast("int"),
    )


def sanitize_url(url: Column) -> Column:
    return F.regexp_replace(strip(url), f"^{URL_EDGE}|{URL_EDGE}$", "")


def _preferred_url(urls: Column) -> Column:
    clean = F.transform(urls, sanitize_url)
    gateway = F.filter(clean, lambda u: contains_ci(u, GATEWAY))
    return F.coalesce(F.try_element_at(gateway, F.lit(1)), F.try_element_at(clean, F.lit(1)))


def request_url(text: Column) -> Column:
    explicit = F.nullif(extract(text, EXPLICIT_URL), F.lit(""))
    return F.coalesce(
        sanitize_url(explicit),
        _preferred_url(F.regexp_extract_all(text, F.lit(JSON_URL), F.lit(1))),
        _preferred_url(F.regexp_extract_all(text, F.lit(ANY_URL), F.lit(0))),
        F.lit(""),
    )


def api_path(url: Column) -> Column:
    path = plain_path(url)
    at = F.locate(GATEWAY, F.lower(path))
    return F.when(at > 0, F.substring(path, at, F.length(path))).otherwise(path)


def server_name(text: Column) -> Column:
    return extract(text, SERVER_NAME)


def machine_name(text: Column) -> Column:
    return first_nonblank(extract(text, MACHINE_NAME), server_name(text))


def environment(text: Column, server: Column, machine: Column) -> Column:
    named = F.upper(extract(text, ENVIRONMENT))
    return F.when(
        named != "", F.when(named == "PRODUCTION", F.lit("PROD")).otherwise(named)
    ).otherwise(environment_of_host(first_nonblank(server, machine)))


def user_name(text: Column) -> Column:
    return extract(text, USER_NAME)


def correlation_id(text: Column) -> Column:
    return extract(text, CORRELATION_ID)


def _starts_ci(text: Column, prefix: str) -> Column:
    return F.startswith(F.lower(text), F.lit(prefix.lower()))


def severity(level: Column, text: Column, status: Column) -> Column:
    name = F.lower(level)
    return (
        F.when(any_of(_starts_ci(strip(text), p) for p in DIAGNOSTIC_PREFIXES), "Information")
        .when(name == "critical", "Critical")
        .when(name == "warning", "Warning")
        .when(name.isin("error", "audit failure") | F.coalesce(status >= 400, F.lit(False)), "Error")
        .otherwise("Information")
    )


def is_stack_line(line: Column) -> Column:
    return F.startswith(line, F.lit("at ")) | _starts_ci(line, "--- End of") | _starts_ci(line, "at lambda_method")


def text_lines(text: Column) -> Column:
    """Trimmed non-empty lines."""
    return F.filter(F.transform(F.split(text, r"[\r\n]"), strip), lambda x: x != "")


def primary_message(text: Column, exception: Column, limit: int | None = MESSAGE_LIMIT) -> Column:
    """First line that says something, without the quotes around it, cut to ``limit`` characters; whole with None."""
    content = unwrap_quotes(text)
    markers = "|".join(METADATA_MARKERS)
    # Everything before the first marker line; a marker at the very start does not cut.
    head = F.regexp_extract(content, rf"(?is)^(.+?)\r?\n(?:{markers})", 1)
    body = strip(F.when(head != "", head).otherwise(content))
    lines = F.filter(
        text_lines(body),
        lambda x: ~is_stack_line(x) & ~any_of(_starts_ci(x, p) for p in METADATA_PREFIXES))
    first = F.try_element_at(lines, F.lit(1))
    said = F.regexp_replace(first, r'^"+|"+$', "")
    return F.coalesce(
        said if limit is None else F.substring(said, 1, limit),
        F.when(nonblank(exception), exception),
        F.lit(DEFAULT_MESSAGE),
    )


def stack_trace(text: Column) -> Column:
    return F.array_join(F.filter(text_lines(text), is_stack_line), "\n")


def raw_content(level, ts, source, event_id, category, text) -> Column:
    return F.concat_ws(
        "\t", level, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), source, event_id.cast("string"),
        category, text)
