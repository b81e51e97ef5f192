"""Priority rules: base score, cause, impact and checks by kind of failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import contains_any, text

# Rule id, base score, likely cause, impact, recommended checks.
RULES = [
    (
        "database_timeout", 80,
        "A database command or connection exceeded its configured timeout.",
        "Application requests may be delayed or fail while waiting for the database.",
        [
            "Check SQL blocking and long-running queries.",
            "Review database CPU, memory and connection usage.",
            "Identify the stored procedure or query involved.",
            "Verify command timeout and connection timeout settings.",
        ],
    ),
    (
        "template_timeout", 75,
        "Template processing exceeded its configured execution limit.",
        "Document, email or template-based processing may be delayed or fail.",
        [
            "Review the template being processed.",
            "Check downstream database and service calls.",
            "Review processing duration before the timeout.",
            "Verify whether the timeout threshold is appropriate.",
        ],
    ),
    (
        "null_reference", 65,
        "An application object or dependency was null when accessed.",
        "The affected operation may fail until the missing value or dependency is corrected.",
        [
            "Review the top application stack frame.",
            "Check database lookups that may return null.",
            "Verify dependency injection registrations.",
            "Validate request fields and configuration values.",
        ],
    ),
    (
        "authentication", 70,
        "Authentication or authorization validation failed.",
        "Users or systems may be unable to access the requested operation.",
        [
            "Verify the token, cookie or Windows identity.",
            "Check user roles and permissions.",
            "Review authentication service availability.",
            "Confirm clock synchronization and token expiry.",
        ],
    ),
    (
        "server_error", 85,
        "The server failed while processing the request.",
        "The requested business operation may be unavailable.",
        [
            "Review the related exception and stack trace.",
            "Check downstream services and database connectivity.",
            "Review recent deployments and configuration changes.",
            "Correlate failures using request or correlation IDs.",
        ],
    ),
    (
        "client_error", 45,
        "The request was rejected because of invalid input, missing data or client-side validation.",
        "The specific request cannot be completed until the request data is corrected.",
        [
            "Capture and compare the request payload.",
            "Review API model-validation errors.",
            "Verify required headers and parameters.",
            "Confirm the client is using the expected API contract.",
        ],
    ),
    (
        "live_connection", 50,
        "The real-time SignalR connection was interrupted.",
        "Live updates or notifications may be temporarily delayed.",
        [
            "Check application pool recycling or server restarts.",
            "Review network and proxy timeout settings.",
            "Verify the SignalR endpoint is reachable.",
            "Check whether the client automatically reconnected.",
        ],
    ),
    (
        "warning", 25,
        "The application detected a condition that may require attention.",
        "No confirmed failure is visible, but the condition may contribute to later incidents.",
        [
            "Review surrounding log entries.",
            "Check whether the warning repeats frequently.",
            "Confirm whether an error follows the warning.",
            "Compare with normal application behavior.",
        ],
    ),
    (
        "unclassified", 35,
        "The available log evidence is not sufficient to identify a specific cause.",
        "The impact should be validated using surrounding logs and application context.",
        [
            "Review surrounding log entries.",
            "Inspect the complete stack trace.",
            "Check related application and infrastructure logs.",
            "Correlate the event with recent changes.",
        ],
    ),
]
# Words that select a rule.
DATABASE_TIMEOUT_WORDS = [
    "sql timeout", "command timeout", "execution timeout expired", "database timeout",
]
TEMPLATE_TIMEOUT_WORDS = ["templateexecutionexception", "template execution timed out"]
AUTHENTICATION_WORDS = ["unauthorized", "authentication failed", "access denied"]
# Occurrence count bonus, and score bands of the priorities.
FREQUENCY_BONUS = [(100, 15), (50, 12), (20, 8), (5, 4)]
PRIORITY_BANDS = [(85, "Critical"), (65, "High"), (40, "Medium")]


def rule_id(message: Column, exception: Column, status: Column) -> Column:
    """Which rule applies; the first match wins."""
    words = F.lower(F.concat(text(exception), F.lit(" "), text(message)))
    code = F.coalesce(status, F.lit(0))
    return (
        F.when(contains_any(words, DATABASE_TIMEOUT_WORDS), "database_timeout")
        .when(contains_any(words, TEMPLATE_TIMEOUT_WORDS), "template_timeout")
        .when(F.contains(words, F.lit("nullreferenceexception")), "null_reference")
        .when(code.isin(401, 403) | contains_any(words, AUTHENTICATION_WORDS), "authentication")
        .when(code >= 500, "server_error")
        .when(code >= 400, "client_error")
        .when(
            F.contains(words, F.lit("signalr")) & F.contains(words, F.lit("disconnected")),
            "live_connection",
        )
        .when(F.contains(words, F.lit("warning")), "warning")
        .otherwise("unclassified")
    )


def priority_of(score: Column) -> Column:
    chain = None
    for low, name in PRIORITY_BANDS:
        chain = F.when(score >= low, name) if chain is None else chain.when(score >= low, name)
    return chain.otherwise("Low")


def frequency_bonus(count: Column) -> Column:
    chain = None
    for low, bonus in FREQUENCY_BONUS:
        chain = F.when(count >= low, bonus) if chain is None else chain.when(count >= low, bonus)
    return chain.otherwise(0)


def _rule_table() -> Column:
    """The nine rules as one literal map, so a look-up needs no join."""
    pairs = []
    for name, base, cause, impact, checks in RULES:
        pairs += [
            F.lit(name),
            F.struct(
                F.lit(base).alias("base"),
                F.lit(cause).alias("likely_cause"),
                F.lit(impact).alias("impact"),
                F.array(*[F.lit(c) for c in checks]).alias("recommended_checks"),
            ),
        ]
    return F.create_map(*pairs)


def intelligence(message: Column, exception: Column, status: Column, count: Column) -> Column:
    """Struct of priority, score, cause, impact and checks."""
    rule = F.element_at(_rule_table(), rule_id(message, exception, status))
    score = F.least(rule["base"] + frequency_bonus(count), F.lit(100))
    return F.struct(
        priority_of(score).alias("priority"),
        score.alias("priority_score"),
        rule["likely_cause"].alias("likely_cause"),
        rule["impact"].alias("impact"),
        rule["recommended_checks"].alias("recommended_checks"),
    )
