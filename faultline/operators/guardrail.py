"""Reports cut back to what confirmed claims support.

A report row and the claims of its incident (at most a few dozen) meet on the
incident id; every check is then an array expression inside that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import blank, clamp, contains_any, distinct_ci, nonblank, norm, strip
from faultline.operators.report import UNKNOWN, is_unknown, row

# Wording of unsupported conclusions.
CONNECTION_WORDS = ["connection issue", "connection failure", "connection instability", "connection stability", "check database connection"]
INCREASE_WORDS = ["increase", "raise", "extend", "too low", "insufficient timeout"]
TIMEOUT_PHRASES = ["execution timeout expired", "wait operation timed out"]
SCOPE_SENTENCE = "determine whether all requests or only specific requests are affected"
CANDIDATES_SHOWN = 5


def claims_by_incident(claims: DataFrame) -> DataFrame:
    """``strong`` and ``weak`` claim arrays per incident, in claim order."""
    claim = F.struct("claim_no", "category", "label", "value", "authority", "confidence_score")
    return claims.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_confirmed"), claim))).alias("strong"),
        F.array_sort(F.collect_list(F.when(F.col("is_weak"), claim))).alias("weak"))


def _has(test) -> Column:
    return F.exists("strong", test)


def _eq(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def _within(part: Column, whole: Column) -> Column:
    return nonblank(part) & F.contains(F.lower(whole), F.lower(part))


def guarded_application(name: Column) -> Column:
    ok = _has(lambda c: (F.lower(c["category"]) == "application") & _eq(c["value"], name))
    return F.when(~is_unknown(name) & ok, name).otherwise(UNKNOWN)


def guarded_workflow(name: Column) -> Column:
    ok = _has(lambda c: F.contains(F.lower(c["label"]), F.lit("workflow")) & _eq(c["value"], name))
    return F.when(~is_unknown(name) & ok, name).otherwise(UNKNOWN)


def timeout_evidence() -> Column:
    return _has(lambda c: (c["authority"] == "RawLog") & (
        contains_any(F.lower(c["value"]), TIMEOUT_PHRASES)
        | (F.contains(F.lower(c["label"]), F.lit("sql error number")) & (strip(c["value"]) == "-2"))))


def concludes_connection(text: Column) -> Column:
    return contains_any(F.lower(text), CONNECTION_WORDS)


def unsafe_timeout_advice(text: Column) -> Column:
    low = F.lower(text)
    return F.contains(low, F.lit("timeout")) & contains_any(low, INCREASE_WORDS)


def guarded_summary(summary: Column, timeout: Column) -> Column:
    return F.when(
        timeout & concludes_connection(summary),
        "The incident contains confirmed database command execution-timeout evidence. "
        "The available evidence does not establish a database connection failure.").otherwise(summary)


def guarded_action(a: Column, timeout: Column) -> Column:
    said = F.concat_ws(" ", a["title"], a["action"], a["reason"])
    safe = row(
        title="Investigate the timed-out database operation",
        action="Review the failing database operation for execution duration, blocking, execution-plan behavior, resource pressure, and parameter-specific behavior.",
        reason="The confirmed evidence shows a database command execution timeout. It does not independently establish a connection failure.",
        expected_outcome="Evidence identifying why the database operation exceeded its execution threshold.",
        suggested_owner=a["suggested_owner"], estimated_effort=a["estimated_effort"],
        confidence_score=F.greatest(a["confidence_score"], F.lit(85)))
    return F.when(timeout & concludes_connection(said), safe).otherwise(a)


def hypothesis_confidence(score: Column, supporting: Column) -> Column:
    return F.when(score <= 0, F.when(F.size(supporting) > 0, 40).otherwise(20)).otherwise(clamp(score, 10, 95))


def guarded_root_causes(causes: Column, timeout: Column) -> Column:
    no_proof = F.lit("No authoritative evidence currently confirms a database connection failure.")

    def one(c: Column) -> Column:
        score = hypothesis_confidence(c["confidence_score"], c["supporting_evidence"])
        wrong = timeout & concludes_connection(F.concat_ws(" ", c["title"], c["explanation"]))
        against = c["contradicting_evidence"]
        already = F.exists(against, lambda x: F.lower(x) == F.lower(no_proof))
        pick = lambda new, old: F.when(wrong, new).otherwise(old)
        return row(
            title=pick(F.lit("Database operation exceeded execution timeout"), c["title"]),
            explanation=pick(F.lit("Confirmed evidence indicates that a database command exceeded its configured execution threshold. "
                                   "The evidence does not establish that the database connection itself was unstable."), c["explanation"]),
            confidence_score=pick(F.greatest(score, F.lit(70)), score),
            supporting_evidence=c["supporting_evidence"],
            contradicting_evidence=F.when(wrong & ~already, F.concat(against, F.array(no_proof))).otherwise(against))

    return F.transform(causes, one)


def guarded_components(items: Column) -> Column:
    return distinct_ci(F.filter(items, lambda i: F.exists("strong", lambda c: _eq(c["value"], i))))


def guarded_dependencies(findings: Column) -> Column:
    return F.filter(findings, lambda d: F.exists(
        "strong", lambda c: (F.lower(c["category"]) == "dependency") & _eq(c["value"], d["name"])))


def guarded_sql(queries: Column) -> Column:
    def grounded(query: Column, c: Column) -> Column:
        label = F.lower(c["label"])
        named = F.contains(label, F.lit("database name")) & nonblank(query["database_name"]) & _eq(c["value"], query["database_name"])
        used = contains_any(label, ["database object", "database operation"]) & F.contains(F.lower(query["query"]), F.lower(c["value"]))
        return (F.lower(c["category"]) == "database") & (named | used)

    return F.filter(queries, lambda query: nonblank(query["query"]) & F.exists("strong", lambda c: grounded(query, c)))


def guarded_code(locations: Column) -> Column:
    def grounded(place: Column, c: Column) -> Column:
        owner = _within(place["class_name"], c["value"]) | _within(place["method_name"], c["value"])
        in_repository = (c["authority"] == "RepositoryMatch") & (owner | _within(place["file_path"], c["value"]))
        in_stack = (c["authority"] == "RawLog") & (F.lower(c["category"]) == "stack") & owner
        return in_repository | in_stack

    return F.filter(locations, lambda place: F.exists("strong", lambda c: grounded(place, c)))


def guarded_impact(impact: Column, application: Column, workflow: Column) -> Column:
    neutral = row(
        severity=impact["severity"], customer_impact="Customer impact has not been confirmed from the available evidence.",
        operational_impact=F.when(blank(impact["operational_impact"]), "Operational impact requires validation.").otherwise(impact["operational_impact"]),
        financial_impact=impact["financial_impact"], scope="The affected application/workflow scope has not been confirmed.",
        confidence_score=F.least(impact["confidence_score"], F.lit(50)))
    known = (F.lower(application) != "unknown") & (F.lower(workflow) != "unknown")
    return F.when(known, impact).otherwise(neutral)


def guarded_recommendations(items: Column, timeout: Column) -> Column:
    conditional = row(
        title="Review timeout only after confirming root cause",
        description="A timeout proves that the configured execution threshold was reached. It does not prove that the threshold is too low. "
                    "Validate query execution, blocking, resource pressure, execution plan, and dependency behavior first.",
        recommendation_type="Conditional", risk="Increasing the timeout may mask the underlying performance problem.", confidence_score=90)
    return F.transform(items, lambda r: F.when(
        timeout & unsafe_timeout_advice(F.concat_ws(" ", r["title"], r["description"])), conditional).otherwise(r))


def guarded_steps(items: Column, workflow: Column) -> Column:
    neutral = F.lit(f"Validate whether the issue is still occurring and {SCOPE_SENTENCE}.")
    return F.transform(items, lambda s: row(
        sequence=s["sequence"], title=s["title"],
        action=F.when((F.lower(workflow) == "unknown") & F.contains(F.lower(s["action"]), F.lit(SCOPE_SENTENCE)), neutral).otherwise(s["action"]),
        reason=s["reason"], expected_outcome=s["expected_outcome"], priority=s["priority"], confidence_score=s["confidence_score"]))


def guarded_confidence(score: Column) -> Column:
    n = F.size("strong")
    mean = F.aggregate("strong", F.lit(0.0), lambda a, c: a + c["confidence_score"]) / n
    evidence = F.when(n == 0, 25).otherwise(F.bround(mean, 0).cast("int"))
    return F.when(score <= 0, clamp(evidence, 20, 90)).otherwise(
        clamp(F.floor((score + evidence) / F.lit(2)).cast("int"), 20, 90))


def equivalent_unknowns(values: Column) -> Column:
    """Keep the first of statements that mean the same."""
    def key(v: Column) -> Column:
        return F.regexp_replace(norm(v), r"\.+$", "")

    def about(k: Column) -> list[Column]:
        return [
            F.contains(k, F.lit("application identity")),
            F.contains(k, F.lit("affected workflow")) | (k == "workflow"),
            contains_any(k, ["database object relationship", "physical database"]),
        ]

    def same(a: Column, b: Column) -> Column:
        out = a == b
        for x, y in zip(about(a), about(b)):
            out = out | (x & y)
        return out

    return F.aggregate(
        F.filter(values, nonblank), F.array().cast("array<string>"),
        lambda kept, v: F.when(F.exists(kept, lambda k: same(key(k), key(v))), kept).otherwise(
            F.concat(kept, F.array(strip(v)))))


def guarded_unknowns(existing: Column, application: Column, workflow: Column, timeout: Column) -> Column:
    fuzzy = F.slice(F.filter("weak", lambda c: c["authority"] == "FuzzyContext"), 1, CANDIDATES_SHOWN)
    return equivalent_unknowns(F.concat(
        existing,
        F.array_compact(F.array(
            F.when(F.lower(application) == "unknown", "Application identity has not been confirmed by authoritative evidence."),
            F.when(F.lower(workflow) == "unknown", "Affected workflow has not been confirmed by authoritative evidence."),
            F.when(timeout, "The reason the database operation exceeded the execution timeout has not been confirmed."))),
        F.transform(fuzzy, lambda c: F.concat(
            F.lit("Candidate context not treated as fact: "), c["label"], F.lit(" = "), c["value"]))))


def guarded_reports(report_rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Every check applied; the columns stay those of the report."""
    none = F.array().cast("array<struct<claim_no:int,category:string,label:string,value:string,authority:string,confidence_score:int>>")
    with_claims = report_rows.join(claims_by_incident(claims), "incident_id", "left").withColumns(
        {c: F.coalesce(c, none) for c in ("strong", "weak")})
    identified = with_claims.withColumns({
        "application_name": guarded_application(F.col("application_name")),
        "affected_workflow": guarded_workflow(F.col("affected_workflow")),
        "timeout": timeout_evidence()})
    app, flow, timeout = F.col("application_name"), F.col("affected_workflow"), F.col("timeout")
    return identified.withColumns({
        "executive_summary": guarded_summary(F.col("executive_summary"), timeout),
        "next_action": guarded_action(F.col("next_action"), timeout),
        "affected_components": guarded_components(F.col("affected_components")),
        "root_causes": guarded_root_causes(F.col("root_causes"), timeout),
        "investigation_steps": guarded_steps(F.col("investigation_steps"), flow),
        "suggested_sql": guarded_sql(F.col("suggested_sql")),
        "code_locations": guarded_code(F.col("code_locations")),
        "dependency_findings": guarded_dependencies(F.col("dependency_findings")),
        "business_impact": guarded_impact(F.col("business_impact"), app, flow),
        "recommendations": guarded_recommendations(F.col("recommendations"), timeout),
        "overall_confidence": guarded_confidence(F.col("overall_confidence")),
        "unknowns": guarded_unknowns(F.col("unknowns"), app, flow, timeout),
    }).select(*report_rows.columns)
