"""Model responses as a table: parsed, merged into reports, and guarded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import blank, clamp, distinct_ci, nonblank, strip
from faultline.operators.guardrail import guarded_reports
from faultline.operators.report import row
from faultline.sources.json_text import json_object, json_objects

MAX_HYPOTHESES, MAX_EVIDENCE = 2, 4


def strip_fences(content: Column) -> Column:
    """Text inside a code fence, or the text itself."""
    return strip(F.regexp_replace(F.regexp_replace(strip(content), r"(?i)^```(?:json)?", ""), r"```$", ""))


def string_or_array(text: Column) -> Column:
    """JSON text of a string, an array or null as an array of non-blank strings."""
    listed = F.from_json(text, "array<string>")
    return F.filter(F.when(text.rlike(r"^\s*\["), listed).when(nonblank(text), F.array(text)).otherwise(
        F.array().cast("array<string>")), nonblank)


def parse_responses(responses: DataFrame) -> DataFrame:
    """``incident_id, is_successful, content`` to summary, action, hypotheses or an error."""
    body = responses.withColumn("_text", strip_fences(F.col("content")))
    ok = F.try_parse_json("_text").isNotNull() & F.col("_text").rlike(r"^\s*\{")
    parsed = body.withColumn("_doc", F.when(ok, json_object(F.col("_text"))))
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    hypotheses = F.transform(
        F.coalesce(json_objects(at(F.col("_doc"), "hypotheses")), F.array().cast("array<map<string,string>>")),
        lambda h: row(
            cause=F.coalesce(at(h, "cause"), F.lit("")), evidence=string_or_array(at(h, "evidence")),
            confidence=F.coalesce(at(h, "confidence").try_cast("int"), F.lit(0))))
    error = (
        F.when(~F.col("is_successful"), "The model call was not successful.")
        .when(blank(F.col("content")), "The model returned an empty response.")
        .when(F.lower("_text") == "null", "The model response could not be deserialized.")
        .when(F.col("_doc").isNull(), "Invalid model JSON.")
        .otherwise(""))
    return parsed.select(
        "incident_id", error.alias("error"),
        F.coalesce(at(F.col("_doc"), "summary"), F.lit("")).alias("summary"),
        F.coalesce(at(F.col("_doc"), "nextaction"), F.lit("")).alias("next_action"), hypotheses.alias("hypotheses"))


def _root_cause(h: Column) -> Column:
    found = distinct_ci(h["evidence"], MAX_EVIDENCE)
    return row(
        title=h["cause"],
        explanation=F.when(F.size(found) == 0, "Additional evidence is required to validate this hypothesis.").otherwise(F.array_join(found, " ")),
        confidence_score=clamp(h["confidence"], 0, 100), supporting_evidence=found,
        contradicting_evidence=F.array().cast("array<string>"))


def merge_responses(report_rows: DataFrame, parsed: DataFrame, claims: DataFrame) -> DataFrame:
    """Reports with usable responses merged in; then guarded like any report."""
    good = parsed.filter(F.col("error") == "").select(
        "incident_id", F.col("summary").alias("_summary"), F.col("next_action").alias("_action"), F.col("hypotheses").alias("_hypotheses"))
    both = report_rows.join(good, "incident_id", "left")
    base = F.col("next_action")
    action = row(
        title="Recommended next action", action=strip(F.col("_action")),
        reason="This action was selected from the strongest confirmed evidence.",
        expected_outcome="Evidence that confirms or eliminates the leading hypothesis.",
        suggested_owner=base["suggested_owner"], estimated_effort=base["estimated_effort"],
        confidence_score=F.greatest(base["confidence_score"], F.lit(80)))
    merged = both.withColumns({
        "executive_summary": F.when(nonblank(F.col("_summary")), strip(F.col("_summary"))).otherwise(F.col("executive_summary")),
        "next_action": F.when(nonblank(F.col("_action")), action).otherwise(base),
        "root_causes": F.when(F.size("_hypotheses") > 0, F.transform(F.slice("_hypotheses", 1, MAX_HYPOTHESES), _root_cause)).otherwise(F.col("root_causes")),
    })
    return guarded_reports(merged.select(*report_rows.columns), claims)
