"""The text of an investigation: one column per incident, for batch export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import distinct_ci, nonblank, strip

STACK_LIMIT, RAW_LIMIT = 4000, 5000
RULER = "=" * 72
# What an investigation has to answer, by mode.
OBJECTIVES = {
    "Quick": [
        "INVESTIGATION MODE: QUICK", "", "Focus only on the most useful immediate findings.", "", "Determine:",
        "1. What most likely failed.", "2. Where the failure most likely occurred.",
        "3. The top three root-cause hypotheses.", "4. The first five investigation actions.",
        "5. Any immediate recovery action supported by evidence.", "6. Confidence and missing information.", "",
        "Keep recommendations concise and operationally actionable.",
    ],
    "Deep": [
        "INVESTIGATION MODE: DEEP", "", "Perform a complete production-support investigation.", "", "Determine:",
        "1. What failed.", "2. The affected business workflow.", "3. The most likely failure point.",
        "4. Affected application components.", "5. Downstream and upstream dependencies.",
        "6. Root-cause hypotheses with supporting evidence.", "7. A prioritized investigation checklist.",
        "8. Suggested SQL queries when supported by context.",
        "9. Suggested source-code locations when supported by context.",
        "10. Immediate and permanent resolution recommendations.", "11. Business and operational impact.",
        "12. Prevention opportunities.", "13. Confidence, assumptions, and unknowns.",
    ],
    "RootCauseAnalysis": [
        "INVESTIGATION MODE: ROOT CAUSE ANALYSIS", "", "Produce a formal root-cause-oriented investigation.", "",
        "Determine:", "1. Incident timeline.", "2. Initial failure point.", "3. Failure propagation chain.",
        "4. Primary root cause.", "5. Contributing factors.", "6. Supporting and contradicting evidence.",
        "7. Detection gaps.", "8. Immediate corrective actions.", "9. Permanent corrective actions.",
        "10. Preventive actions.", "11. Monitoring and logging improvements.",
        "12. Assumptions, unknowns, and confidence.",
    ],
}


def sanitize(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\0"), F.lit("")))


def or_unknown(c: Column) -> Column:
    return F.when(nonblank(c), sanitize(c)).otherwise("Unknown")


def limited(c: Column, limit: int) -> Column:
    s = sanitize(c)
    return F.when(~nonblank(c), "Unknown").when(F.length(s) <= limit, s).otherwise(
        F.concat(F.substring(s, 1, limit), F.lit("...[truncated]")))


def round_trip(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), or_unknown(value))


def _header(title: str) -> list[Column]:
    return [F.lit(RULER), F.lit(title), F.lit(RULER)]


def _distinct_values(values: Column) -> Column:
    """Trimmed, non-blank, first spelling ignoring case."""
    return distinct_ci(F.transform(F.filter(values, nonblank), sanitize))


def _bullets(label: str, values: Column) -> Column:
    text = F.array_join(_distinct_values(values), "\n- ")
    return F.concat(F.lit(f"{label}:\n- "), F.coalesce(F.nullif(text, F.lit("")), F.lit("Unknown")))


def _nested(label: str, values: Column) -> Column:
    """Indented list, or nothing."""
    text = F.nullif(F.array_join(_distinct_values(values), "\n    - "), F.lit(""))
    return F.concat(F.lit(f"  {label}:\n    - "), text)


def lines(*parts) -> Column:
    return F.concat_ws("\n", *parts)


def _match_rows(df: DataFrame, name: str, kind: str | None, nested: dict[str, str], out: str) -> DataFrame:
    title = F.concat(
        F.lit("- "), sanitize(F.col(name)),
        F.concat(F.lit(" ("), sanitize(F.col(kind)), F.lit(")")) if kind else F.lit(""),
        F.lit(", Match Score: "), F.col("match_score").cast("string"), F.lit("%"))
    text = lines(title, F.concat(F.lit("  Description: "), or_unknown(F.col("description"))),
                 *[_nested(label, F.col(c)) for label, c in nested.items()])
    return df.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))["text"].alias(out))


def evidence_text(
    evidence: DataFrame, include_stack: bool = True, include_raw: bool = True, stack_limit: int = STACK_LIMIT, raw_limit: int = RAW_LIMIT,
) -> DataFrame:
    """Rendered evidence of each incident; the columns of the evidence itself stay whole."""
    status = F.col("http_status").cast("string")
    labelled = [
        ("Line", F.col("line_number").cast("string")), ("Timestamp", round_trip(F.col("ts"))), ("Severity", F.col("severity")),
        ("Exception", F.col("exception_type")), ("Message", F.col("message")), ("HTTP Status", status),
        ("API Path", F.col("api_path")), ("Request URL", F.col("request_url")), ("Server", F.col("server_name")),
        ("Machine", F.col("machine_name")), ("Environment", F.col("environment")), ("Correlation ID", F.col("correlation_id")),
    ]
    parts = [F.concat(F.lit(f"  {label}: "), or_unknown(v)) for label, v in labelled]
    if include_stack:
        parts.append(F.concat(F.lit("  Stack Trace: "), limited(F.col("stack_trace"), stack_limit)))
    if include_raw:
        parts.append(F.concat(F.lit("  Raw Content: "), limited(F.col("raw_content"), raw_limit)))
    text = lines(F.concat(F.lit("Evidence "), F.col("evidence_no").cast("string"), F.lit(":")), *parts, F.lit(""))
    return evidence.groupBy("incident_id").agg(
        F.count(F.lit(1)).cast("int").alias("evidence_count"),
        F.array_join(F.array_sort(F.collect_list(F.struct("evidence_no", text.alias("text"))))["text"], "\n").alias("evidence_text"))


def pattern_text(patterns: DataFrame) -> DataFrame:
    text = lines(
        F.concat(F.lit("- Exception: "), or_unknown(F.col("exception_type"))),
        F.concat(F.lit("  HTTP Status: "), F.coalesce(F.col("http_status").cast("string"), F.lit("Unknown"))),
        F.concat(F.lit("  Occurrences: "), F.col("occurrence_count").cast("string")),
        F.concat(F.lit("  Message: "), or_unknown(F.col("message"))))
    return patterns.groupBy("incident_id").agg(
        F.count(F.lit(1)).cast("int").alias("pattern_count"),
        F.array_join(F.array_sort(F.collect_list(F.struct("pattern_no", text.alias("text"))))["text"], "\n").alias("pattern_text"))


def investigation_text(
    incidents: DataFrame, environments: DataFrame, rollup: DataFrame, components: DataFrame, workflows: DataFrame,
    issues: DataFrame, evidence: DataFrame, patterns: DataFrame, application_name: str, mode: str = "Deep",
    question: str = "", include_known_issues: bool = True, include_stack: bool = True, include_raw: bool = True,
) -> DataFrame:
    """Per incident: ``investigation_text``, ``metadata`` map, ``token_estimate``."""
    deps = {"Match Reasons": "match_reasons"}
    joined = (
        incidents.withColumnRenamed("environment", "incident_environment")
        .join(environments, "incident_id")
        .join(rollup, "incident_id")
        .join(_match_rows(components, "name", "type", {**deps, "Dependencies": "dependencies", "Database Objects": "database_objects"}, "_c"), "incident_id", "left")
        .join(_match_rows(workflows, "name", None, {**deps, "Workflow Steps": "steps", "Dependencies": "dependencies"}, "_w"), "incident_id", "left")
        .join(_match_rows(issues, "title", None, {
            **deps, "Likely Causes": "likely_causes", "Investigation Steps": "investigation_steps",
            "Resolution Steps": "resolution_steps", "Suggested Queries": "suggested_queries"}, "_i"), "incident_id", "left")
        .join(evidence_text(evidence, include_stack, include_raw), "incident_id", "left")
        .join(pattern_text(patterns), "incident_id", "left"))
    listed = lambda c, heading, none: F.concat(F.lit(f"{heading}:\n"), F.coalesce(F.array_join(F.col(c), "\n"), F.lit(none)))
    app, env = F.lit(application_name), F.col("environment")
    i = lambda label, c: _line(label, F.col(c).cast("string"))
    text = lines(
        *_header("INVESTIGATION REQUEST"),
        _line("Application", app), _line("Environment", env), _line("Mode", F.lit(mode)), _line("Engineer Question", F.lit(question)), F.lit(""),
        *_header("INCIDENT SUMMARY"),
        i("Incident ID", "incident_id"), i("Title", "title"), i("Severity", "severity"), i("Exception", "exception_type"),
        i("HTTP Status", "http_status"), i("API Path", "api_path"), i("Server", "server_name"), i("Environment", "incident_environment"),
        i("Correlation ID", "correlation_id"), i("Occurrence Count", "entry_count"),
        _line("Started At", round_trip(F.col("started_at"))), _line("Ended At", round_trip(F.col("ended_at"))), F.lit(""),
        *_header("APPLICATION CONTEXT"),
        _line("Application", app), F.concat(F.lit("Context Confidence: "), F.col("confidence_score").cast("string"), F.lit("%")),
        _bullets("Dependencies", F.col("dependencies")), _bullets("Database Objects", F.col("database_objects")),
        _bullets("Investigation Hints", F.col("investigation_hints")),
        listed("_c", "Matched Components", "- Unknown"), listed("_w", "Matched Workflows", "- Unknown"),
        *([listed("_i", "Matched Known Issues", "- None matched")] if include_known_issues else []), F.lit(""),
        *_header("REPRESENTATIVE EVIDENCE"),
        F.coalesce("evidence_text", F.lit("No representative evidence was available.\n")),
        *_header("RELATED ERROR PATTERNS"),
        F.coalesce(F.concat("pattern_text", F.lit("\n")), F.lit("No related error patterns were available.\n")),
        *_header("INVESTIGATION OBJECTIVES"), F.lit("\n".join(OBJECTIVES[mode])))
    count = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "incident_id", strip(text).alias("investigation_text"), "environment", "confidence_score",
        count("evidence_count").alias("evidence_count"), count("pattern_count").alias("pattern_count"),
    ).withColumns({
        "metadata": F.create_map(*[x for k, v in {
            "IncidentId": or_unknown(F.col("incident_id")), "Application": or_unknown(app), "Environment": or_unknown(env),
            "Mode": F.lit(mode), "EvidenceCount": F.col("evidence_count").cast("string"),
            "ErrorPatternCount": F.col("pattern_count").cast("string"), "ContextConfidence": F.col("confidence_score").cast("string"),
        }.items() for x in (F.lit(k), v)]),
        "token_estimate": token_estimate(F.col("investigation_text")),
    })


def token_estimate(*sections: Column) -> Column:
    """About four characters per token, at least one."""
    chars = sum(F.when(nonblank(s), F.length(s)).otherwise(0) for s in sections)
    return F.greatest(F.ceil(chars / F.lit(4.0)).cast("int"), F.lit(1))
