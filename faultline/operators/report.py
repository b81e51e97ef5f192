"""Investigation reports: one row per incident, lists as arrays of structs.

Everything here is a projection over ``cases`` (one row per incident), so a
report costs no shuffle of its own. ``child`` turns a list into a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import clamp, contains_any, distinct_ci, lines_of, nonblank, strip
from faultline.operators.investigation_text import _distinct_values, sanitize

UNKNOWN = "Unknown"
# Words that reveal a workflow when none was matched, first hit wins.
WORKFLOW_WORDS = [
    (["xpertdoc", "templateexecutionexception"], "Document or Template Generation"),
    (["getmpacimages", "mpac"], "MPAC Image Retrieval"),
    (["aciapi"], "ACI Integration"),
    (["authenticateuser"], "User Authentication"),
]
# Words that tell the kind of a dependency, first hit wins.
DEPENDENCY_TYPES = [
    (["database", "sql"], "Database"),
    (["api", "service", "integration"], "External or Application Service"),
    (["queue", "message"], "Messaging"),
]
# Points by number of evidence entries and of dependencies; weights; states.
EVIDENCE_POINTS = [(8, 100), (5, 80), (3, 60), (1, 40)]
DEPENDENCY_POINTS = [(3, 100), (2, 80), (1, 60)]
COMPLETENESS_WEIGHTS = {
    "evidence": 0.25, "context": 0.20, "workflow": 0.15, "dependencies": 0.10, "root_cause": 0.15,
    "business_impact": 0.10, "change_history": 0.05,
}
COMPLETENESS_STATES = [(80, "Complete"), (50, "Partial"), (1, "Limited")]
ASSUMPTIONS = [
    "The supplied representative evidence accurately reflects the selected incident.",
    "The application knowledge file is current and correctly maps APIs, workflows, and dependencies.",
    "The incident grouping has not combined unrelated failures.",
]
FIXED_UNKNOWNS = [
    "Deployment and configuration change history were not provided.",
    "The mock decision engine cannot verify source-code implementation details.",
    "Downstream response payloads and database state were not provided.",
]


def is_unknown(c: Column) -> Column:
    return ~nonblank(c) | (F.lower(c) == "unknown")


def is_ignored_value(c: Column) -> Column:
    """Values that say nothing."""
    return ~nonblank(c) | F.lower(c).isin("unknown", "none matched", "not detected")


def value_or_unknown(c: Column) -> Column:
    return F.when(is_unknown(c), UNKNOWN).otherwise(strip(c))


def say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def row(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def steps(score: Column, bands, otherwise) -> Column:
    chain = None
    for low, value in bands:
        chain = F.when(score >= low, value) if chain is None else chain.when(score >= low, value)
    return chain.otherwise(otherwise)


def first_word_hit(text: Column, table, otherwise: str) -> Column:
    chain = None
    for needles, value in table:
        hit = contains_any(text, needles)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(otherwise)


def workflow_inference(text: Column) -> Column:
    return first_word_hit(F.lower(text), WORKFLOW_WORDS, UNKNOWN)


def dependency_type(name: Column) -> Column:
    return first_word_hit(F.lower(name), DEPENDENCY_TYPES, "Application Dependency")


def overall_confidence(context: Column, evidence: Column, patterns: Column) -> Column:
    score = (
        F.lit(25) + F.least(F.floor(context / F.lit(2)), F.lit(40)) + F.least(evidence * 3, F.lit(20))
        + F.least(patterns * 2, F.lit(15)))
    return clamp(score, 20, 90).cast("int")


def path_segments(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, "/"), strip), lambda s: s != "")


def controller_name(path: Column) -> Column:
    """Segment after ``api``, otherwise the last but one."""
    seg = path_segments(path)
    at = F.array_position(F.transform(seg, F.lower), F.lit("api")).cast("int")
    return F.when(is_unknown(path), UNKNOWN).when(
        (at > 0) & (at < F.size(seg)), F.try_element_at(seg, at + 1)).otherwise(
        F.coalesce(F.try_element_at(seg, F.lit(-2)), F.lit(UNKNOWN)))


def method_name(path: Column) -> Column:
    return F.when(is_unknown(path), UNKNOWN).otherwise(
        F.coalesce(F.try_element_at(path_segments(path), F.lit(-1)), F.lit(UNKNOWN)))


def component_label(item: Column) -> Column:
    """Component text without its score and type."""
    bare = F.regexp_extract(item, r"(?is)^(.*?)(?:, Match Score:.*)?$", 1)
    return strip(F.when(F.locate("(", bare) > 1, F.substring_index(bare, "(", 1)).otherwise(bare))


def component_items(components: DataFrame) -> DataFrame:
    """Per incident, the lines a reader sees under the matched components."""
    title = F.concat(
        sanitize(F.col("name")), F.lit(" ("), sanitize(F.col("type")), F.lit("), Match Score: "),
        F.col("match_score").cast("string"), F.lit("%"))
    items = F.concat(F.array(title), *[_distinct_values(F.col(c)) for c in ("match_reasons", "dependencies", "database_objects")])
    return components.groupBy("incident_id").agg(
        F.filter(F.flatten(F.array_sort(F.collect_list(F.struct("rank", items.alias("i"))))["i"]),
                 lambda v: ~is_ignored_value(v)).alias("component_items"))


def cases(
    incidents: DataFrame, texts: DataFrame, rollup: DataFrame, components: DataFrame, workflows: DataFrame,
    application_name: str,
) -> DataFrame:
    """What a report needs to know about each incident; unknown texts read ``Unknown``."""
    first_flow = workflows.filter(F.col("rank") == 1).select("incident_id", F.col("name").alias("_workflow"))
    known = lambda c: value_or_unknown(F.col(c))
    real = lambda c: F.filter(_distinct_values(F.col(c)), lambda v: ~is_ignored_value(v))
    none = F.array().cast("array<string>")
    return (
        incidents.select("incident_id", "exception_type", "api_path", "server_name", "correlation_id", "entry_count")
        .join(texts.drop("confidence_score"), "incident_id")
        .join(rollup, "incident_id")
        .join(component_items(components), "incident_id", "left")
        .join(first_flow, "incident_id", "left")
        .select(
            "incident_id", "investigation_text", "metadata",
            F.lit(application_name if application_name.strip() else UNKNOWN).alias("application_name"),
            known("environment").alias("environment"), known("exception_type").alias("exception_type"),
            known("api_path").alias("api_path"), known("server_name").alias("server"),
            known("correlation_id").alias("correlation_id"), F.col("entry_count").alias("occurrence_count"),
            F.col("confidence_score").alias("context_confidence"), "evidence_count", "pattern_count",
            F.coalesce("component_items", none).alias("component_items"),
            real("dependencies").alias("dependencies"), real("database_objects").alias("database_objects"),
            F.when(is_unknown(F.col("_workflow")), workflow_inference(F.col("investigation_text"))).otherwise(
                strip(F.col("_workflow"))).alias("workflow"),
            overall_confidence(F.col("confidence_score"), F.col("evidence_count"), F.col("pattern_count")).alias("confidence"))
    )


def executive_summary() -> Column:
    n, path, flow, exc = F.col("occurrence_count"), F.col("api_path"), F.col("workflow"), F.col("exception_type")
    return say(
        F.col("application_name"), " experienced an incident in ", F.col("environment"), ". ",
        F.when(n > 0, say(n.cast("string"), " occurrences were detected")).otherwise("The occurrence count could not be determined"), " ",
        F.when(~is_unknown(path), say("for ", path)).when(~is_unknown(flow), say("within the ", flow, " workflow")).otherwise("within the application"), ". ",
        F.when(~is_unknown(exc), say("The failures produced ", exc, ".")).otherwise("The exact exception type could not be determined."),
        " Additional evidence validation is required before confirming the final root cause.")


def next_action() -> Column:
    cid, path, c = F.col("correlation_id"), F.col("api_path"), F.col("confidence")
    trace = row(
        title="Trace the failed request",
        action=say("Search application, dependency, and database logs using correlation ID ", cid, "."),
        reason="The correlation ID is the strongest available link for reconstructing the request path and locating the first failure point.",
        expected_outcome="A chronological request timeline showing the controller, service, database, and dependency involved in the failure.",
        suggested_owner="Production Support", estimated_effort="10–15 minutes", confidence_score=clamp(c + 5, 50, 95))
    compare = row(
        title="Compare successful and failed API requests",
        action=say("Compare a successful request with a failed request for ", path, ", including input, headers, response, and stack trace."),
        reason="The affected API is known, but a correlation ID is not available. Comparing executions is the fastest way to identify the differing input or dependency response.",
        expected_outcome="Identification of the request, data, configuration, or dependency difference that triggers the failure.",
        suggested_owner="Production Support", estimated_effort="15–30 minutes", confidence_score=clamp(c, 45, 90))
    inspect = row(
        title="Inspect the earliest complete stack trace",
        action=say("Locate the earliest complete stack trace for ", F.col("exception_type"), " within the ", F.col("workflow"), " workflow."),
        reason="The API and correlation identifier are not currently known. The earliest stack trace is the strongest available evidence for identifying the first failing component.",
        expected_outcome="Identification of the class, method, component, or dependency where the failure originated.",
        suggested_owner="Production Support", estimated_effort="15–30 minutes", confidence_score=clamp(c - 5, 35, 85))
    return F.when(~is_unknown(cid), trace).when(~is_unknown(path), compare).otherwise(inspect)


def completeness() -> Column:
    deps, no_flow = F.size("dependencies"), is_unknown(F.col("workflow"))
    scores = {
        "evidence": steps(F.col("evidence_count"), EVIDENCE_POINTS, 0),
        "context": F.col("context_confidence"),
        "workflow": F.when(no_flow, 0).otherwise(100),
        "dependencies": steps(deps, DEPENDENCY_POINTS, 0),
        "root_cause": F.col("confidence"),
        "business_impact": F.when(no_flow, 30).otherwise(70),
        "change_history": F.lit(0),
    }
    total = None
    for name, weight in COMPLETENESS_WEIGHTS.items():
        part = scores[name].cast("double") * F.lit(weight)
        total = part if total is None else total + part
    said = {
        "evidence": ("Evidence", say(F.col("evidence_count").cast("string"), " representative evidence entries were selected.")),
        "context": ("Application context", F.lit("Score produced by the application context resolver.")),
        "workflow": ("Workflow", F.when(no_flow, "The business workflow could not be identified.").otherwise(say("Matched workflow: ", F.col("workflow"), "."))),
        "dependencies": ("Dependencies", say(deps.cast("string"), " mapped dependencies were identified.")),
        "root_cause": ("Root cause", F.lit("Current confidence in the leading root-cause hypothesis.")),
        "business_impact": ("Business impact", F.when(no_flow, "Business impact cannot be fully mapped without a workflow.").otherwise(
            "Business impact was inferred from the mapped workflow and occurrences.")),
        "change_history": ("Change history", F.lit("Deployment and configuration history are not connected yet.")),
    }
    items = F.array(*[
        row(name=said[k][0], score=clamp(scores[k], 0, 100), status=steps(scores[k], COMPLETENESS_STATES, "Missing"), explanation=said[k][1])
        for k in scores])
    missing = F.array_compact(F.array(
        F.when(is_unknown(F.col("api_path")), "Affected API or operation is not available."),
        F.when(is_unknown(F.col("correlation_id")), "Correlation ID is unavailable."),
        F.lit("Deployment and configuration change history is unavailable."),
        F.when(deps == 0, "No dependency mapping was identified.")))
    return row(overall_score=clamp(F.bround(total, 0).cast("int"), 0, 100), items=items, missing_information=missing)


def root_cause_title() -> Column:
    exc, path = F.col("exception_type"), F.col("api_path")
    return F.when(~is_unknown(exc), say(exc, " in the affected application workflow")).when(
        ~is_unknown(path), say("Failure while processing ", path)).otherwise("Application processing failure")


def root_causes() -> Column:
    exc, path, server, n, c = (F.col(x) for x in ("exception_type", "api_path", "server", "occurrence_count", "confidence"))
    found = F.array_compact(F.array(
        F.when(~is_unknown(exc), say("The incident consistently reports ", exc, ".")),
        F.when(~is_unknown(path), say("The failure is associated with API path ", path, ".")),
        F.when(~is_unknown(server), say("The failure was observed on server ", server, ".")),
        F.when(n > 0, say("The failure occurred ", n.cast("string"), " times."))))
    listed = lambda *t: F.array(*[F.lit(x) if isinstance(x, str) else x for x in t])
    return F.array(
        row(title=root_cause_title(),
            explanation=say("The incident evidence indicates that ", path, " failed while processing a request and produced ", exc,
                            ". The precise failing statement and invalid condition must be confirmed using the earliest stack trace and correlated request evidence."),
            confidence_score=clamp(c, 35, 90),
            supporting_evidence=F.when(F.size(found) == 0, listed("The prepared reasoning package contains limited incident evidence.")).otherwise(found),
            contradicting_evidence=listed("The mock decision engine cannot inspect source code, deployment history, database state, or downstream responses.")),
        row(title="Downstream dependency or invalid response",
            explanation="The error may have originated from a downstream dependency returning invalid, incomplete, or unexpected data to the affected application workflow.",
            confidence_score=clamp(c - 15, 20, 75),
            supporting_evidence=F.when(~is_unknown(path), listed(say("The error is associated with endpoint ", path, "."), "Application context may include downstream dependencies.")).otherwise(
                listed("The application context contains dependency information.")),
            contradicting_evidence=listed("No downstream response payload or availability evidence was provided.")),
        row(title="Application validation or error-handling gap",
            explanation="The application may not be validating an input or dependency response before processing it, allowing an invalid value to produce the observed exception.",
            confidence_score=clamp(c - 25, 15, 65),
            supporting_evidence=F.when(~is_unknown(exc), listed(say("The observed exception is ", exc, "."), "Validation and controlled error handling should be reviewed near the failure point.")).otherwise(
                listed("The failure produced an application-level error.")),
            contradicting_evidence=listed("The exact method and failing statement have not yet been confirmed.")))


def investigation_steps() -> Column:
    cid = F.col("correlation_id")

    def one(sequence, title, action, reason, outcome, priority, score):
        return row(sequence=sequence, title=title, action=action, reason=reason, expected_outcome=outcome, priority=priority, confidence_score=score)

    return F.array(
        one(1, "Confirm the failure scope",
            say("Validate whether the issue is still occurring in ", F.col("workflow"), " and determine whether all requests or only specific requests are affected."),
            "Confirming scope prevents unnecessary troubleshooting and helps establish business impact.",
            "Clear understanding of whether the incident is active, intermittent, request-specific, or system-wide.", "High", 95),
        one(2, "Trace the affected request",
            F.when(~is_unknown(cid), say("Search all application and dependency logs using correlation ID ", cid, ".")).otherwise(
                "Identify a failed request and capture its correlation ID, request ID, or timestamp."),
            "A correlation identifier provides the most reliable way to reconstruct the request flow.",
            "A complete request timeline across the controller, services, database, and downstream integrations.", "High",
            F.when(is_unknown(cid), 75).otherwise(95)),
        one(3, "Inspect the first failure point",
            say("Review the earliest stack trace and error associated with ", F.col("api_path"), " and ", F.col("exception_type"), "."),
            "The earliest failure generally identifies the true origin, while later errors may only be consequences.",
            "Identification of the controller, service, repository, database, or downstream call where processing first failed.", "High", 90),
        one(4, "Compare successful and failed requests",
            say("Compare a successful request with a failed request on ", F.col("server"), ", including payload, headers, dependency responses, and processing time."),
            "Differences between successful and failed executions often reveal invalid input, configuration, or dependency behavior.",
            "A specific input, response, configuration, or workflow difference that explains the failure.", "High", 85),
        one(5, "Validate dependencies and database operations",
            "Check the health and response details of mapped dependencies and validate related database reads or writes.",
            "Application errors frequently originate from unavailable dependencies, malformed responses, connectivity failures, or data inconsistencies.",
            "Confirmation or elimination of database and downstream-system involvement.", "Medium", 80))


def suggested_sql() -> Column:
    cid = F.col("correlation_id")
    safe = F.filter(F.slice("database_objects", 1, 3), lambda o: o.rlike(r"^[\p{L}\p{Nd}_.\[\]]+$"))
    return F.transform(safe, lambda o: row(
        title=say("Review recent records in ", o), database_name=UNKNOWN,
        purpose="Validate whether the affected request created or updated related database records.",
        query=F.when(~is_unknown(cid), say(
            "SELECT TOP (100) *\nFROM ", o, "\nWHERE CorrelationId = '", F.replace(cid, F.lit("'"), F.lit("''")), "'\nORDER BY 1 DESC;")).otherwise(
            say("SELECT TOP (100) *\nFROM ", o, ";")),
        expected_outcome="Records related to the incident timeframe or correlation ID are returned for validation.",
        confidence_score=F.when(is_unknown(cid), 55).otherwise(75)))


def code_locations() -> Column:
    path = F.col("api_path")

    def one(name, reason, score):
        return row(project=UNKNOWN, file_path=UNKNOWN, class_name=name, method_name=method_name(path), reason=reason, confidence_score=score)

    listed = F.transform(F.slice("component_items", 1, 3), lambda i: one(
        component_label(i), "This component was matched by the application context resolver and is associated with the affected API or workflow.", 70))
    by_path = F.array(one(controller_name(path), "The API path indicates the likely controller and action entry point for investigation.", 60))
    return F.when(F.size("component_items") > 0, listed).when(~is_unknown(path), by_path).otherwise(F.slice(by_path, 1, 0))


def dependency_findings() -> Column:
    return F.transform(F.slice("dependencies", 1, 10), lambda d: row(
        name=d, type=dependency_type(d), role="Mapped dependency associated with the affected application component or workflow.",
        risk="Validate availability, latency, authentication, response format, and recent changes.", confidence_score=70))


def business_impact() -> Column:
    n, env, flow = F.col("occurrence_count"), F.col("environment"), F.col("workflow")
    prod = F.upper(env).isin("PROD", "PRODUCTION")
    return row(
        severity=F.when(prod & (n >= 100), "High").when(prod & (n > 0), "Medium").when(n >= 100, "Medium").otherwise("Low"),
        customer_impact=F.when(is_unknown(flow), "Unknown. The affected customer journey has not been fully identified.").otherwise(
            say("Users of the ", flow, " workflow may experience failed or incomplete requests.")),
        operational_impact=F.when(n > 0, say(n.cast("string"), " failed or error-producing occurrences were identified.")).otherwise("The occurrence scope is currently unknown."),
        financial_impact="Unknown. No transaction value or financial-impact data was supplied.",
        scope=F.when(prod, "Production environment impact detected.").otherwise(say("Impact detected in ", env, ".")),
        confidence_score=clamp(F.col("confidence") - 10, 20, 85))


def recommendations() -> Column:
    return F.array(
        row(title="Add input and dependency-response validation",
            description=say("Validate all required inputs and downstream responses before processing them in ", F.col("api_path"), "."),
            recommendation_type="Permanent", risk="Low when implemented with backward-compatible validation and controlled error handling.",
            confidence_score=clamp(F.col("confidence"), 40, 85)),
        row(title="Improve structured diagnostic logging",
            description=say("Log the correlation ID, sanitized request identifiers, dependency status, response content type, and the exact component producing ", F.col("exception_type"), "."),
            recommendation_type="Preventive", risk="Low, provided sensitive values and payloads are not logged.", confidence_score=90),
        row(title="Add targeted monitoring and alerting",
            description="Create alerts for repeated failures on the affected API and dependency, using occurrence thresholds and a defined incident window.",
            recommendation_type="Preventive", risk="Low. Alert thresholds should be tuned to avoid noise.", confidence_score=85))


def text_lines(text: Column) -> Column:
    """Trimmed lines of a text; put them in a column before they are used twice."""
    return F.transform(lines_of(F.regexp_replace(text, "\r", "\n")), strip)


def labelled_values(lines: Column, label: str, limit: int, ignored=is_ignored_value) -> Column:
    """Distinct values of lines that start with a label, in order of appearance."""
    low = label.lower()
    values = F.transform(
        F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit(low))), lambda x: strip(F.substr(x, F.lit(len(label) + 1))))
    return distinct_ci(F.filter(values, lambda v: ~ignored(v)), limit)


def evidence_references() -> Column:
    cid = F.col("correlation_id")
    messages = labelled_values(text_lines(F.col("investigation_text")), "Message:", 10, is_unknown)
    return F.transform(messages, lambda m, i: row(
        evidence_type="Log Entry", description=m, source=say("Prepared Evidence ", (i + 1).cast("string")),
        correlation_id=F.when(is_unknown(cid), "").otherwise(cid)))


def unknowns() -> Column:
    return F.array_compact(F.array(
        *[F.lit(x) for x in FIXED_UNKNOWNS],
        F.when(is_unknown(F.col("workflow")), "The affected business workflow could not be determined."),
        F.when(is_unknown(F.col("api_path")), "The affected API or operation could not be determined."),
        F.when(is_unknown(F.col("correlation_id")), "No correlation ID was available to reconstruct the complete request flow.")))


def reports(case_rows: DataFrame) -> DataFrame:
    """The full report of every incident."""
    return case_rows.select(
        "incident_id", "application_name", "environment", executive_summary().alias("executive_summary"),
        next_action().alias("next_action"), completeness().alias("completeness"),
        F.col("workflow").alias("affected_workflow"), F.col("component_items").alias("affected_components"),
        root_causes().alias("root_causes"), investigation_steps().alias("investigation_steps"),
        suggested_sql().alias("suggested_sql"), code_locations().alias("code_locations"),
        dependency_findings().alias("dependency_findings"), business_impact().alias("business_impact"),
        recommendations().alias("recommendations"), evidence_references().alias("evidence_references"),
        F.col("confidence").alias("overall_confidence"), unknowns().alias("unknowns"),
        F.array(*[F.lit(a) for a in ASSUMPTIONS]).alias("assumptions"))


def child(report_rows: DataFrame, column: str) -> DataFrame:
    """A list of the report as a table: ``incident_id, position`` and its fields."""
    rows = report_rows.select("incident_id", F.posexplode(column).alias("position", "item")).withColumn(
        "position", F.col("position") + 1)
    if dict(rows.dtypes)["item"].startswith("struct"):
        return rows.select("incident_id", "position", "item.*")
    return rows
