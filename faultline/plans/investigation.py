"""All incidents to guarded investigation reports in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from faultline.operators import context as ctx, distill, evidence as ev, guardrail, report
from faultline.operators.investigation_text import investigation_text
from faultline.operators.timeline import timeline_events, timeline_groups
from faultline.plans.staging import staged
from faultline.sources.knowledge import KnowledgeBase


@dataclass
class Investigation:
    texts: DataFrame
    cases: DataFrame
    timeline: DataFrame
    claims: DataFrame
    reports: DataFrame
    guarded: DataFrame


def investigate(
    incidents: DataFrame, entries: DataFrame, summaries: DataFrame, kb: KnowledgeBase, application_name: str,
    mode: str = "Deep", question: str = "", max_evidence: int = ev.EVIDENCE_DEFAULT,
    max_facts: int | None = distill.MAX_FACTS,
) -> Investigation:
    """``entries`` carry the ``incident_id`` they belong to. Claims, and what the guardrail decides by them, come from the
    ``max_facts`` strongest facts of an incident, from all with None."""
    hits = staged(ctx.context_hits(incidents, entries, ctx.all_terms(kb)), "hits")
    components = staged(ctx.component_match(incidents, entries, kb, hits), "components")
    workflows = staged(ctx.workflow_match(incidents, entries, kb, components, hits), "workflows")
    issues = staged(ctx.known_issue_match(incidents, entries, kb, hits), "issues")
    rollup = staged(ctx.context_rollup(incidents, components, workflows, issues), "rollup")
    chosen = staged(ev.representative_evidence(entries, max_evidence), "evidence")
    patterns = ev.error_pattern_match(incidents, summaries)
    texts = staged(investigation_text(
        incidents, ev.evidence_environment(incidents, chosen), rollup, components, workflows, issues, chosen,
        patterns, application_name, mode, question), "texts")
    case_rows = report.cases(incidents, texts, rollup, components, workflows, application_name)
    claims = distill.evidence_claims(distill.distilled_facts(texts, max_facts))
    rows = staged(report.reports(case_rows), "reports")
    return Investigation(
        texts, case_rows, timeline_events(timeline_groups(chosen)), claims, rows, guardrail.guarded_reports(rows, claims))
